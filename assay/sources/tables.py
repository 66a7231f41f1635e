"""Tables by name, and readers and writers with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "cases": "id long, name_hi string, kind string, existing_en string, existing_src string, item string, status string, created double",
    "clips": "id string, case_id long, file string, corpus string, source string, licence string, speaker string, district string, state string, gender string, sentence string, start_s double, end_s double, dur_s double, snr_db double, synthetic boolean, cut_cer double, xvec array<float>",
    "witness": "clip_id string, witness string, text string, conf double",
    "decision": "id long, case_id long, officer string, action string, record struct<devanagari:string,ipa:string,notes:string,roman:string>, reason string, ts double",
    "audit": "id long, ts_micros long, actor string, action string, case_id long, detail string, prev_hash string, hash string",
    "hits": "corpus string, path string, rg int, row int, name string, start int, end int, text string, duration double",
    "gazetteer": "hi string, en string, item string",
    "targets": "hi string, en string, kind string",
    "exceptions": "name string, form string, scheme string, reason string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str = SCHEMAS["gazetteer"]) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = SCHEMAS["hits"]) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mapping(spark: SparkSession, paths: list[str], key: str, schema: str) -> DataFrame:
    """Small YAML documents (a list of mappings, or a mapping by key); the last file wins on equal keys."""
    import yaml

    rows: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or []
        items = found if isinstance(found, list) else [{key: k, **v} for k, v in found.items()]
        rows |= {x[key]: x for x in items}
    return spark.createDataFrame(list(rows.values()), schema)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet", most: int | None = None) -> DataFrame:
    """(path, bytes) of the files of a folder by path, or of the first `most`; contents are not read."""
    out = read_files(spark, path, pattern).select("path", F.col("length").alias("bytes")).orderBy("path")
    return out if most is None else out.limit(most)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def truncate(spark: SparkSession, path: str, schema: str) -> None:
    """A Parquet table without rows in place of what was there. A log that is emptied starts again from its first entry."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def indented_json(df: DataFrame, key: list[str], most: int = 100_000) -> str:
    """A small result as indented JSON with letters as they are, by key. More than `most` rows raise: a report is no export."""
    rows = df.orderBy(*key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([json.loads(r.j) for r in rows], indent=1, ensure_ascii=False)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys are not in new, and those of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_key(old: DataFrame, new: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """All rows of the keys in gone are removed before new ones are added."""
    return old.join(gone.select(key).distinct(), key, "left_anti").unionByName(new)


def resume(spark: SparkSession, found: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """What is not in the journal yet."""
    return found.join(journal.select(F.col(key)), key, "left_anti")
