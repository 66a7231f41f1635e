"""Hash-chained audit logs: append by one writer, chain whole logs, verify in parallel."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "genesis"
FIELDS = ["ts_micros", "actor", "action", "case_id", "detail"]


def entry_hash() -> Column:
    """Hash of an entry with the one before. Times are whole microseconds, so their text is the same everywhere."""
    return F.sha2(F.concat_ws("|", "prev_hash", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]), 256)


def append(log: DataFrame, new: list[dict]) -> DataFrame:
    """log with new entries at its end. The fold is in order, so only one writer may append; it reads the last entry alone."""
    last = log.orderBy(F.desc("id")).select("id", "hash").head(1)
    number, prev = (last[0].id, last[0].hash) if last else (0, GENESIS)
    rows = []
    for x in new:
        number += 1
        text = "|".join([prev, *("" if x.get(c) is None else str(x[c]) for c in FIELDS)])
        rows.append((number, *(x.get(c) for c in FIELDS), prev, hashlib.sha256(text.encode()).hexdigest()))
        prev = rows[-1][-1]
    schema = "id long, ts_micros long, actor string, action string, case_id long, detail string, prev_hash string, hash string"
    return log.unionByName(log.sparkSession.createDataFrame(rows, schema))


def verify(log: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """(ok, first_bad): the least id whose hash or link is wrong. Links across cells of ids are checked by the cells' ends."""
    own = log.withColumn("_ok", entry_hash() == F.col("hash")).withColumn("_cell", F.floor(F.col("id") / cell))
    ends = own.groupBy("_cell").agg(F.max_by("hash", "id").alias("_last"))
    ends = ends.withColumn("_end", F.lag("_last", 1, GENESIS).over(W.orderBy("_cell"))).drop("_last")
    before = F.lag("hash").over(W.partitionBy("_cell").orderBy("id"))
    linked = own.withColumn("_before", before).join(ends, "_cell").withColumn("_link", F.coalesce("_before", "_end") == F.col("prev_hash"))
    return linked.agg(F.min(F.when(~(F.col("_ok") & F.col("_link")), F.col("id"))).alias("first_bad")).select(F.col("first_bad").isNull().alias("ok"), "first_bad")


def linked(prev: Column, fields: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", prev, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def chain(entries: DataFrame, log: str, key: str, fields: list[str]) -> DataFrame:
    """entries of many logs, in the order of key, with prev_hash and hash.

    A hash needs the one before it, so a log is one ordered fold by its nature and must fit a task; logs run side by side.
    """
    rest = [c for c in entries.columns if c != log]
    listed = entries.groupBy(log).agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in rest if c != key]))).alias("_x"))
    start = F.array(F.lit(GENESIS))
    hashes = F.aggregate("_x", start, lambda acc, e: F.concat(acc, F.array(linked(F.element_at(acc, -1), [e[f] for f in fields]))))
    out = listed.withColumn("_h", hashes).select(log, F.posexplode("_x").alias("_i", "_e"), "_h")
    return out.select(log, "_e.*", F.get("_h", F.col("_i")).alias("prev_hash"), F.get("_h", F.col("_i") + 1).alias("hash"))


def verify_logs(entries: DataFrame, log: str, key: str, fields: list[str]) -> DataFrame:
    """(log, ok, first_bad) of many logs: the least key whose hash or link is wrong. No fold: every entry is checked by itself."""
    before = F.lag("hash", 1, GENESIS).over(W.partitionBy(log).orderBy(key))
    bad = (linked(F.col("prev_hash"), [F.col(f) for f in fields]) != F.col("hash")) | (F.col("prev_hash") != before)
    return entries.withColumn("_bad", bad).groupBy(log).agg(F.min(F.when(F.col("_bad"), F.col(key))).alias("first_bad")).select(log, F.col("first_bad").isNull().alias("ok"), "first_bad")
