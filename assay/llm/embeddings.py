"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

The windows of single projections hold a fifth of all vectors, so counting over a whole label would be quadratic. Vectors are
posted first: in each of several tables, a cell is the number of the fixed random direction on which the vector lies farthest
out (or of several such directions, each among its own). `LAYOUTS` grow with the largest label, so that a cell of evenly
spread vectors holds about `EVEN` at most: the work grows in proportion to the vectors, and the number of tables with the
logarithm of their number. Within a cell, further projections are sorted one by one; a window of half-width `WINDOW` link
lengths around every member counts collisions for each pair, and pairs with at least the calibrated count are verified by
their cosine in double precision. A pair that shares the cells of several tables counts in the first alone.

Calibration: along independent normal directions, two vectors at the asked cosine are normal with that correlation, in any
number of dimensions. So the chance of sharing a cell is simulated, and the number of tables and the least count are set so
that a link at the very limit is missed with probability `MISS`, half of it by the cells and half by the count; farther
above the limit it is less.

Cells over `TILE` members are dealt into tiles and pairs of tiles, so no task holds an unbounded cell. Equal vectors are
folded first and weigh as many as they are. Tasks emit sums and spanning forests, never all pairs of a group. Distinct
vectors that lie densely (more than `TILE` within a link's length) are compared pair by pair: their links are counted singly.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with
nothing and are kept; vectors of different lengths never link; repeated rows are vectors of their own; empty tables work;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

COSINE = 0.93
#: (directions, how many such directions name a cell), with more cells from one to the next.
LAYOUTS = [(256, 1), (2048, 1), (256, 2), (1024, 2), (1024, 3)]
EVEN = 128
COUNTED, WINDOW, MISS = 24, 1.0, 0.001
TILE = 1024
#: Groups of so many members are counted pair by pair, larger ones by sorted windows.
FEW = 64
SEED = 7
#: Crowded cells that a task may hold.
SHIPPED = 100_000


@cache
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """Independent normal directions, the same on every machine."""
    return np.random.Generator(np.random.PCG64([seed, dim, n])).standard_normal((dim, n))


def least_count(n: int = COUNTED, window: float = WINDOW, miss: float = MISS / 2) -> int:
    """The greatest count that a pair at the link distance reaches but for probability miss."""
    p = erf(window / sqrt(2))
    below, count = 0.0, 0
    while below + comb(n, count) * p**count * (1 - p) ** (n - count) <= miss:
        below += comb(n, count) * p**count * (1 - p) ** (n - count)
        count += 1
    return count


@cache
def tables(cosine: float, across: int, deep: int, miss: float = MISS / 2) -> int:
    """How many tables let a pair at the cosine share no cell with probability miss at most."""
    rng = np.random.Generator(np.random.PCG64([SEED, across]))
    hit, pairs = 0, 0
    while pairs < 8192:
        a = rng.standard_normal((1024, across))
        b = cosine * a + sqrt(1 - cosine**2) * rng.standard_normal((1024, across))
        hit, pairs = hit + int((a.argmax(axis=1) == b.argmax(axis=1)).sum()), pairs + 1024
    shared = min(hit / pairs, 1 - 1e-9) ** deep
    return ceil(log(miss) / log(1 - shared))


def layout(largest: int) -> tuple[int, int]:
    """Directions and depth for labels of at most so many vectors."""
    return next((x for x in LAYOUTS if x[0] ** x[1] * EVEN >= largest), LAYOUTS[-1])


def cells(unit: np.ndarray, across: int, deep: int, n: int, seed: int) -> np.ndarray:
    """The cell of each vector in each of n tables."""
    x, out = unit.astype(np.float32), np.zeros((len(unit), n), dtype=np.int32)
    for t in range(n):
        for k in range(deep):
            farthest = (x @ directions(x.shape[1], across, seed + 1000 + t * deep + k).astype(np.float32)).argmax(axis=1)
            out[:, t] = out[:, t] * across + farthest
    return out


def normed(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def windows(x: np.ndarray, cosine: float) -> np.ndarray:
    """Of each ordered pair of rows, in how many projections the second lies in the first's window."""
    half = WINDOW * np.sqrt(2 - 2 * cosine)
    n = len(x)
    counts = np.zeros(n * n, dtype=np.uint8)
    for line in x.T:
        order = np.argsort(line, kind="stable")
        line = line[order]
        low, high = np.searchsorted(line, line - half), np.searchsorted(line, line + half, side="right")
        size = high - low
        other = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        counts[np.repeat(order, size) * n + order[other]] += 1
    return counts.reshape(n, n)


class Group:
    """The members of cells that one batch holds, all of one dimension."""

    def __init__(self, batch: pa.RecordBatch, dim: int, cosine: float, seed: int) -> None:
        self.unit, self.cosine = normed(batch["v"], dim), cosine
        self.line = self.unit @ directions(dim, COUNTED, seed + 1)
        self.cells = np.asarray(batch["cells"].flatten()).reshape(batch.num_rows, -1)
        self.table, self.side = np.asarray(batch["tab"]), np.asarray(batch["t"])
        self.across = np.asarray(batch["t1"]) != np.asarray(batch["t2"])
        self.n = np.asarray(batch["n"])

    def links(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked places i, j of the same group, but for those that meet in an earlier table."""
        found = [self._near(*kit.pairs_within(starts, np.where(sizes > FEW, 0, sizes)))]
        for a, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            i, j = np.nonzero(np.triu(windows(self.line[a : a + n], self.cosine) >= least_count(), 1))
            found.append(self._near(a + i, a + j, counted=True))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return i, j

    def _near(self, i: np.ndarray, j: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        half, least, out = WINDOW * np.sqrt(2 - 2 * self.cosine), least_count(), []
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            mine = ~self.across[a] | (self.side[a] != self.side[b])
            a, b = a[mine], b[mine]
            if not counted:
                enough = (np.abs(self.line[a] - self.line[b]) <= half).sum(axis=1) >= least
                a, b = a[enough], b[enough]
            near = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.cosine
            a, b = a[near], b[near]
            first = (self.cells[a] == self.cells[b]).argmax(axis=1) == self.table[a]
            out.append((a[first], b[first]))
        return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _told(part: pa.RecordBatch, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows with how many vectors each member is linked with (n > 0), and edges of a spanning forest (n = 0)."""
    h, g = (np.asarray(part[c]) for c in ("h", "g"))
    links = np.bincount(i, weights=n[j], minlength=len(h)) + np.bincount(j, weights=n[i], minlength=len(h))
    forest = kit.Forest()
    edge = np.array([(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b)], dtype=np.int64).reshape(-1, 2)
    some = np.flatnonzero(links)
    a, b = np.concatenate([some, edge[:, 0]]), np.concatenate([some, edge[:, 1]])
    weight = np.concatenate([links[some], np.zeros(len(edge))]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[a], g[a], h[b], g[b], weight)], names=["h", "g", "h2", "g2", "n"])


def near_duplicates(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = SEED) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    v = F.col("v")
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("l"))
    usable = v.isNotNull() & F.col("l").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("ok", F.col("ok") & (F.when(F.col("ok"), norm).otherwise(0.0) > 0))
    # Two independent 64-bit hashes name a vector with its label.
    named = rows.where("ok").select("id", "v", F.xxhash64("l", "v").alias("h"), F.xxhash64(F.lit("again"), F.reverse("v"), "l").alias("g"), F.col("l").cast("string").alias("l"))
    distinct = kit.cut(named.groupBy("h", "g").agg(F.min(F.struct("id", "l", "v")).alias("x"), F.count("*").alias("n")).select("h", "g", F.col("x.l").alias("l"), F.col("x.v").alias("v"), F.col("x.id").alias("low"), "n"))

    largest = distinct.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    across, deep = layout(largest)
    n_tables = tables(cosine, across, deep)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["dim"])
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                found = cells(normed(part["v"], int(dim)), across, deep, n_tables, seed)
                ends = np.arange(0, part.num_rows * n_tables + 1, n_tables, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))], names=[*part.schema.names, "cells"])

    members = distinct.select("h", "g", F.xxhash64(F.lit("label"), "l").alias("lab"), F.size("v").alias("dim"), "v", "n")
    schema = T.StructType([*members.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    members = kit.cut(members.mapInArrow(post, schema))
    cell = ["lab", "dim", "tab", "cell"]
    crowded = members.select("lab", "dim", F.posexplode("cells").alias("tab", "cell")).groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    crowded = kit.cut(crowded)
    posted = members.select("*", F.posexplode("cells").alias("tab", "cell"))
    # Crowded cells are few unless vectors lie densely; they are shipped only when they are.
    posted = posted.join(F.broadcast(crowded) if crowded.count() <= SHIPPED else crowded, cell, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = posted.withColumn("t", F.pmod("g", "tiles").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    keys = [*cell, "t1", "t2"]
    dealt = dealt.select(*cell, F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "t", "h", "g", "v", "n", "cells")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in kit.whole_groups(batches, keys):
            dims = np.asarray(whole["dim"])
            ends = np.append(at[1:], whole.num_rows)
            for dim in np.unique(dims[at]):
                mine = np.flatnonzero(dims == dim)
                own = dims[at] == dim
                sizes = (ends - at)[own]
                part = whole.take(pa.array(mine))
                group = Group(part, int(dim), cosine, seed)
                i, j = group.links(np.cumsum(sizes) - sizes, sizes)
                yield _told(part, group.n, i, j)

    lists = dealt.repartition(*keys).sortWithinPartitions(*keys)
    found = kit.cut(lists.mapInArrow(count, "h long, g long, h2 long, g2 long, n long"))
    links = found.where("n > 0").groupBy("h", "g").agg(F.sum("n").alias("n_links"))
    ids = distinct.select("h", "g", "low")
    edges = found.where("n = 0").join(ids.withColumnRenamed("low", "a"), ["h", "g"]).join(ids.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("low").alias("b")), ["h2", "g2"]).select("a", "b")
    reach = kit.components(edges)
    classes = kit.cut(
        distinct.join(links, ["h", "g"], "left").join(reach.select(F.col("id").alias("low"), "component"), "low", "left")
        .select("h", "g", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    )
    linked = named.select("id", "h", "g").join(classes, ["h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
