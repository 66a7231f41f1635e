"""Top-k, winners with margins, diverse selection, samples and blocked nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band(score: Column, high: float = 75, medium: float = 55) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order. Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def winner(df: DataFrame, case: str, candidate: str, weight: str, items: str) -> DataFrame:
    """(case, candidate, support, margin, items): one row a case, from one row a candidate. Ties go to the lesser candidate."""
    total = W.partitionBy(case)
    share = df.withColumn("support", F.round(F.col(weight) / F.coalesce(F.nullif(F.sum(weight).over(total), F.lit(0.0)), F.lit(1.0)), 4)).withColumn("items", F.sum(items).over(total))
    order = W.partitionBy(case).orderBy(F.desc("support"), F.asc(candidate))
    ranked = share.withColumn("second", F.lead("support", 1, 0.0).over(order)).withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return ranked.select(case, F.col(candidate).alias("candidate"), "support", F.round(F.col("support") - F.col("second"), 4).alias("margin"), "items")


def pick_diverse(df: DataFrame, case: str, speaker: str, best: list[Column], tie: list[str], rounds: int = 3, k: int = 8) -> DataFrame:
    """Up to k rows of a case: the best of every speaker first, then the second ones, in at most `rounds` rounds."""
    mine = df.withColumn("_round", F.row_number().over(W.partitionBy(case, speaker).orderBy(*best))).where(F.col("_round") <= rounds)
    return top_k(mine, [case], [F.asc("_round"), *[F.asc(t) for t in tie]], k).drop("_round")


def sample_k(df: DataFrame, group: str, key: str, seed: int, k: int) -> DataFrame:
    """k rows of each group without replacement, the same for equal seeds."""
    return top_k(df, [group], [F.sha1(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))).asc(), F.asc(key)], k)


#: Members of a group that one task compares with each other at once.
TILE = 4096


def in_tiles(df: DataFrame, group: list[str], key: str, tile: int = TILE) -> DataFrame:
    """df with _t (tile of the row), _t1 and _t2: every two rows of a group meet under one pair of tiles, the same if _t is.

    Groups of up to `tile` rows are one tile. Between two tiles only rows of different tiles are a pair that is new.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    out = df.join(sizes, group).withColumn("_t", F.pmod(F.xxhash64(key), "_tiles").cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumn("_t1", F.least("_t", "_o")).withColumn("_t2", F.greatest("_t", "_o")).drop("_o", "_tiles")


def pairs(df: DataFrame, group: str, key: str, tile: int = TILE) -> DataFrame:
    """(group, key, other): every two keys of a group, the lesser first. df has each key of a group once."""
    tiled = in_tiles(df.select(group, key), [group], key, tile)
    other = tiled.select(group, "_t1", "_t2", F.col("_t").alias("_u"), F.col(key).alias("other"))
    met = tiled.join(other, [group, "_t1", "_t2"]).where((F.col(key) < F.col("other")) & ((F.col("_t1") == F.col("_t2")) | (F.col("_t") != F.col("_u"))))
    return met.select(group, key, "other")


def percentiles(df: DataFrame, group: str, value: str, shares: list[float], cell: float = 1.0) -> DataFrame:
    """(group, p0, p1 ..): linearly interpolated percentiles of the values that are not null.

    Cells of the line are counted first; only the rows of the cells that hold an asked rank are sorted, each cell for itself.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).withColumn("_cell", F.floor(F.col("_v") / cell))
    counts = rows.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    line = W.partitionBy("_g").orderBy("_cell")
    counts = counts.withColumn("_before", F.sum("_n").over(line) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy("_g")))
    at = lambda p: p * (F.col("_all") - 1)
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in shares]))
    asked = counts.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))).drop("_n")
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_g", "_cell").orderBy("_v")) - 1
    found = rows.join(asked, ["_g", "_cell"]).withColumn("_rank", rank).where(F.array_contains(ranks, F.col("_rank")))
    held = found.groupBy("_g", "_all").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("m"))
    value_at = lambda r: F.element_at("m", r)
    out = [(value_at(F.floor(at(p))) + (at(p) - F.floor(at(p))) * (value_at(F.ceil(at(p))) - value_at(F.floor(at(p))))).alias(f"p{i}") for i, p in enumerate(shares)]
    return held.select(F.col("_g").alias(group), *out)


def nearest(left: DataFrame, right: DataFrame, name: str, near: str, distance: Column, left_block: Column, right_block: Column, most: float, k: int, tile: int = TILE) -> DataFrame:
    """(name, near, dist, rank): for each name the k nearest in its block, by (distance, near), itself left out.

    Lengths alone bound the edit distance from below, which spares most distances. A block with more than `tile` names on the
    right is dealt to several tasks by a salt of them, so one block isn't one task.
    """
    right = right.withColumn("_b", right_block)
    sizes = right.groupBy("_b").agg(F.ceil(F.count("*") / tile).cast("int").alias("_salts"))
    right = right.join(sizes, "_b").withColumn("_salt", F.pmod(F.xxhash64(near), "_salts").cast("int")).drop("_salts")
    left = left.withColumn("_b", left_block).join(sizes, "_b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    pairs = left.join(right, ["_b", "_salt"]).where(F.col(name) != F.col(near))
    pairs = pairs.where(F.abs(F.length(name) - F.length(near)) <= most).withColumn("dist", distance).where(F.col("dist") <= most)
    order = W.partitionBy(name).orderBy("dist", near)
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(name, near, "dist", "rank")
