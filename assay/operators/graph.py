"""Connected components of graphs of any size, and union-find for the few nodes of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sources.shared import cut

#: A key with more than this share of a shuffle partition's even part of the rows is dealt to several tasks.
HOT_SHARE = 0.25


class Forest:
    """Union-find over few numbers, in one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def dealt(rows: DataFrame, key: str, table: DataFrame, most: float, by: str = "id") -> DataFrame:
    """rows joined with table, which has one row a key. Keys with more than `most` rows are dealt out by a salt.

    Fewer than (number of rows / most) keys can have so many rows, which bounds what is broadcast.
    """
    hot = F.broadcast(cut(rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_salts")).where("_salts > 1")))
    salt = F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1)))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that can be reached.

    Each round takes the smallest label among the neighbours, then the label of the label, so chains halve. Labels are
    written to the shared folder after each round. Hubs and large components are single keys: messages to a node are
    combined before the shuffle, and joins deal keys with many rows to several tasks.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")))
    heard_by = both.select(F.col("a").alias("id"), F.col("b").alias("from"))
    most_edges, most_nodes = (max(1.0, HOT_SHARE * df.count() / parts) for df in (both, labels))
    while True:
        told = dealt(heard_by, "from", labels.select(F.col("id").alias("from"), "label"), most_edges)
        heard = told.groupBy("id").agg(F.min("label").alias("heard"))
        nearer = cut(labels.join(heard, "id").select("id", F.col("label").alias("was"), F.least("label", "heard").alias("label")))
        of = nearer.select(F.col("id").alias("label"), F.col("label").alias("further"))
        nxt = cut(dealt(nearer, "label", of, most_nodes).select("id", "was", F.col("further").alias("label")))
        if nxt.where("was <> label").isEmpty():
            return nxt.select("id", F.col("label").alias("component"))
        labels = nxt.select("id", "label")
