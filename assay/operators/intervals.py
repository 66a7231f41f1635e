"""Range joins over cells, cumulative bounds, and coalescing of touching ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulative(df: DataFrame, key: str, size: str, cell: int = 4096) -> DataFrame:
    """(key, lo, hi) with lo the sum of the sizes before, by key. Sums of key cells are taken first, so no single task orders all rows."""
    cells = df.withColumn("_cell", F.floor(F.col(key) / cell))
    per = cells.groupBy("_cell").agg(F.sum(size).alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    inside = F.sum(size).over(W.partitionBy("_cell").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    out = cells.withColumn("_in", inside).join(before, "_cell").withColumn("hi", F.coalesce("_before", F.lit(0)) + F.col("_in"))
    return out.select(key, (F.col("hi") - F.col(size)).alias("lo"), "hi")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, cell: int) -> DataFrame:
    """points joined with the ranges [lo, hi) that hold them, as an equi join on cells of the line."""
    p = points.withColumn("_cell", F.floor(F.col(at) / cell))
    r = ranges.where(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))))
    return p.join(r, "_cell").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def coalesce_ranges(df: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """(key, begin, end, n): ranges of a key that touch or overlap become one."""
    order = W.partitionBy(key).orderBy(begin, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.when(F.col(begin) <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")
