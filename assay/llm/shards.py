"""A store of immutable shards with size-tiered compaction and a versioned manifest, in DataFrame functions alone.

Arrivals are appended as runs: folders of small Parquet files, cut at about `SHARD_BYTES`. Compaction puts runs into tiers by
the mean size of their files (each tier `FANOUT` times the last) and merges the runs of a tier with at least `FANOUT` files into
one run with files of about the target size; files over half of it are left alone. No row is shuffled: a merge reads whole
small files and writes them together.

The manifest of a version is a Parquet table with one row a run, so the driver handles names of runs and never lists of files.
A version is published by renaming a small pointer file to its number without overwriting, which one of several writers alone
can do; the other starts again from the newer version. The pointer also holds the store's schema. Folders that no manifest
names are never read, so a job that lost its executors or driver leaves the store as it was. `vacuum` removes what the newest
version does not name.

Cases: empty arrivals make no version; nulls, ties, repeated rows, texts of any length and any columns are stored as they are;
arrivals whose columns are not the store's raise; a store without versions reads as an empty table of the schema it was given.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4
SHARD_BYTES, TARGET_BYTES = 4_000_000, 128_000_000
#: Size of a row in its file, before the store has rows to go by.
ROW_BYTES = 1_000
MANIFEST = "run string, files long, bytes long, rows long"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None) -> None:
        self.spark, self.root, self._given = spark, root.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        for folder in ("versions", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # versions

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0].isdigit())

    def _pointer(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self) -> T.StructType | None:
        """The columns of the store's rows; None if it has neither a version nor a given schema."""
        have = self.versions()
        return T.StructType.fromJson(self._pointer(have[-1])["schema"]) if have else self._given

    def manifest(self, version: int | None = None) -> DataFrame:
        """Runs of a version, the newest unless said."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._pointer(version or have[-1])['manifest']}")

    def publish(self, runs: DataFrame, base: int, schema: T.StructType) -> bool:
        """Make runs the version after base; False if another writer made it first."""
        name = f"manifests/{uuid.uuid4().hex}"
        runs.select("run", "files", "bytes", "rows").coalesce(1).write.parquet(f"{self.root}/{name}")
        draft = self._path(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(f"{self.root}/versions/{base + 1:09d}.json"), self.spark.sparkContext._gateway.new_array(self._rename, 0))
            return True
        except Exception as e:  # a Java exception of one of several kinds, by file system
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False

    def _commit(self, change, schema: T.StructType) -> int:
        """Publish change(manifest), again on the newer version if another writer was first."""
        while True:
            base = (self.versions() or [0])[-1]
            if self.publish(change(self.manifest(base) if base else self.manifest()), base, schema):
                return base + 1

    # data

    def _new_run(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _described(self, run: str, schema: T.StructType) -> DataFrame:
        """The manifest row of a written run; sizes and counts come from the files' own metadata."""
        path = f"{self.root}/{run}"
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        rows = self.spark.read.schema(schema).parquet(path).count()
        return self.spark.createDataFrame([(run, sizes.files, sizes.bytes, rows)], MANIFEST)

    def shard_rows(self) -> int:
        """Rows of a shard of about SHARD_BYTES, by the mean size of the rows stored so far."""
        so_far = self.manifest().agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
        return max(1, SHARD_BYTES * so_far.rows // max(so_far.bytes, 1) if so_far.rows else SHARD_BYTES // ROW_BYTES)

    def append(self, df: DataFrame) -> int | None:
        """Store the rows of df as a run of new shards; the new version, or None if there are no rows."""
        folder = f"{self.root}/landing-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows()).parquet(folder)
        return self.adopt(folder, df.schema)

    def adopt(self, folder: str, schema: T.StructType) -> int | None:
        """Take a written folder of Parquet files on the store's file system in as a run, by renaming it."""
        known = self.schema()
        if known is not None and known.fieldNames() != schema.fieldNames():
            raise ValueError(f"the store has the columns {known.fieldNames()}")
        schema, run = known or schema, self._new_run()
        if not self._fs.rename(self._path(folder), self._path(f"{self.root}/{run}")):
            raise FileNotFoundError(folder)
        new = self._described(run, schema)
        if not new.first().rows:
            self._fs.delete(self._path(f"{self.root}/{run}"), True)
            return None
        return self._commit(lambda old: old.unionByName(new), schema)

    def folders(self, path: str) -> list[str]:
        """The folders in a folder, such as one for each value of a partition column."""
        return sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def _paths(self, runs: DataFrame) -> list[str]:
        return [f"{self.root}/{r.run}" for r in runs.select("run").orderBy("run").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, from the runs its manifest names alone."""
        schema = self.schema()
        if schema is None:
            raise ValueError("a store without versions has no schema unless one is given")
        paths = self._paths(self.manifest(version))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # compaction

    def tiered(self, target: int = TARGET_BYTES) -> DataFrame:
        """The manifest with each run's tier: 0 for files of the target size, one more for each FANOUT that they are smaller."""
        mean = F.col("bytes") / F.col("files")
        below = F.floor(F.log(float(FANOUT), F.lit(float(target)) / F.greatest(mean, F.lit(1.0)))).cast("int") + 1
        return self.manifest().withColumn("tier", F.when(mean * 2 > target, 0).otherwise(F.greatest(below, F.lit(1))))

    def due(self, target: int = TARGET_BYTES) -> DataFrame:
        """(tier, files, bytes) of tiers with enough small files to merge."""
        by = self.tiered(target).where("tier > 0").groupBy("tier").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        return by.where(F.col("files") >= FANOUT)

    def compact(self, target: int = TARGET_BYTES) -> int | None:
        """Merge every tier that is due, the smallest files first, until none is; the newest version."""
        version = None
        while (first := self.due(target).orderBy(F.desc("tier")).first()) is not None:
            names = [r.run for r in self.tiered(target).where(F.col("tier") == first.tier).select("run").collect()]
            schema, run = self.schema(), self._new_run()
            merged = max(1, math.ceil(first.bytes / target))  # fewer than there are: none is over half the target
            self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]).coalesce(merged).write.parquet(f"{self.root}/{run}")
            new, gone = self._described(run, schema), self.spark.createDataFrame([(n,) for n in names], "run string")
            version = self._commit(lambda old, gone=gone, new=new: old.join(F.broadcast(gone), "run", "left_anti").unionByName(new), schema)
        return version

    def vacuum(self) -> int:
        """Remove runs that the newest version does not name; how many. Only when no writer or reader of older versions is active."""
        live = {r.run for r in self.manifest().select("run").collect()}
        dead = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/data")) if f"data/{s.getPath().getName()}" not in live]
        for path in dead:
            self._fs.delete(path, True)
        return len(dead)
