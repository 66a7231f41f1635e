"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at
least six positional bytes: that is the guaranteed minimum of matches. A posting list holds the fingerprints that share the
five positional bytes of its key; a key leaves out one of the `LEFT_OUT` triples, and every two positions are within one of
those, so a pair that shares six bytes meets in a list. In a list the shared positional bytes of each pair are tallied: those
of the key and those among the three left. Pairs below the minimum are rejected, the others verified by their bits.

Lists are read from sorted partitions one after another, so a task holds one list. Its members differ in three bytes only,
so it has at most 2^24 of them, whatever the number of documents; over `SHORT` members, the neighbours of each are looked up
instead of tallying all pairs (a neighbour differs in at most two bits, so it always reaches the minimum). Equal
fingerprints are folded before, so copies never meet in a list, and only a spanning forest of a list's links leaves its task.

Cases: a null or empty text has no word, so its fingerprint is zero and it is linked like any other; texts of any length are
read whole; repeated rows share a fingerprint; rows without an id take their group's component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

SEED, WORDS, BITS = 42, 3, 2
BYTES = 8
#: Byte positions that a posting key leaves out: a smallest set of triples that holds every two positions.
LEFT_OUT = [(0, 1, 2), (0, 2, 7), (0, 3, 5), (0, 4, 6), (1, 3, 4), (1, 5, 6), (1, 5, 7), (2, 3, 4), (2, 5, 6), (3, 6, 7), (4, 5, 7)]
#: Positional bytes that linked fingerprints share at least.
LEAST = BYTES - BITS
#: Lists up to so long are tallied pair by pair.
SHORT = 256


def fingerprint(text: str | None) -> int:
    """Bit k is set if it is set in over half of the hashes of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    h, xxh = [0, *ends], xxhash.xxh64_intdigest
    hashes = np.array([xxh(joined[a : b - 1], SEED) for a, b in zip(h, ends[WORDS - 1 :], strict=False)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text as a long (its bits as they are)."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64))]

    return kit.append(df, [T.StructField(to, T.LongType())], text, work)


def _masks() -> list[int]:
    return [int.from_bytes(bytes(0 if i in out else 255 for i in range(BYTES)), "little", signed=True) for out in LEFT_OUT]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the linked ones among the distinct longs of column fingerprint."""
    fp = F.col("fingerprint")
    byte = lambda i: F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))
    left = lambda out: sum((byte(i) * (1 << 8 * n) for n, i in enumerate(out)), F.lit(0)).cast("int")
    posts = F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), fp.bitwiseAND(F.lit(mask)).alias("shared"), left(out).alias("left")) for k, (out, mask) in enumerate(zip(LEFT_OUT, _masks(), strict=True))])
    lists = distinct.select(F.inline(posts)).repartition("k", "shared").sortWithinPartitions("k", "shared", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in kit.whole_groups(batches, ["k", "shared"]):
            a, b = _forest(*(np.asarray(batch[c]) for c in ("k", "shared", "left")), starts)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        kit.release()

    return lists.mapInArrow(run, "a long, b long").distinct()


def _whole(k: np.ndarray, shared: np.ndarray, left: np.ndarray) -> np.ndarray:
    at, left, out = np.array(LEFT_OUT, dtype=np.uint64) * np.uint64(8), left.astype(np.uint64), shared.view(np.uint64)
    for n in range(at.shape[1]):
        out = out | (left >> np.uint64(8 * n) & np.uint64(255)) << at[k, n]
    return out.view(np.int64)


def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positional bytes members of a list share: those of the key and those among the bytes left."""
    differ = x ^ y
    return BYTES - len(LEFT_OUT[0]) + sum(((differ >> 8 * n) & 255 == 0).astype(np.int64) for n in range(len(LEFT_OUT[0])))


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of a list, which are linked: the count filter first, then the bits of those it retains."""
    out = tally(x, y) >= LEAST
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at] ^ y[at]) <= BITS
    return out


def _forest(k: np.ndarray, shared: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of each list; starts are those of the lists."""
    sizes = np.diff(np.append(starts, len(left)))
    i, j = kit.pairs_within(starts, np.where(sizes > SHORT, 0, sizes))
    good = linked(left[i], left[j])
    edges = [(i[good], j[good])]
    for a, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        edges += [(a + x, a + y) for x, y in _neighbours(left[a : a + n])]
    up = np.arange(len(left))
    forest, kept = kit.Forest(), []
    for i, j in edges:
        new = up[i] != up[j]  # those that were joined before needn't be looked at
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            if forest.join(x, y):
                kept.append((x, y))
        if len(i) > SHORT:
            at = np.unique(np.concatenate([i, j]))
            up[at] = [forest.root(x) for x in at.tolist()]
    i, j = np.array(kept, dtype=np.int64).reshape(-1, 2).T
    return _whole(k[i], shared[i], left[i]), _whole(k[j], shared[j], left[j])


def _neighbours(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a sorted list of distinct numbers that differ in one or two bits, mask by mask."""
    bits = [1 << i for i in range(8 * len(LEFT_OUT[0]))]
    for mask in bits + [x | y for x, y in combinations(bits, 2)]:
        other = left ^ mask
        j = np.minimum(np.searchsorted(left, other), len(left) - 1)
        i = np.flatnonzero((left[j] == other) & (left < other))
        if len(i):
            yield i, j[i]


def grouped(classes: DataFrame) -> DataFrame:
    """(fingerprint, component) of the linked ones among the distinct longs of column fingerprint."""
    return kit.components(links(classes)).select(F.col("id").alias("fingerprint"), "component")


def _spread(classes: DataFrame) -> DataFrame:
    """Few bytes a fingerprint, but many postings: adaptive execution would leave them to a few tasks."""
    return classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row: the smallest key among all rows that links reach."""
    rows = kit.cut(fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("t")), "t").select("id", "fingerprint"))
    classes = kit.cut(_spread(rows.groupBy("fingerprint").agg(F.min("id").alias("low"))))
    of = classes.join(grouped(classes), "fingerprint")
    lowest = of.groupBy("component").agg(F.min("low").alias("lowest"))
    moved = of.join(lowest, "component").select("fingerprint", "lowest")
    groups = kit.cut(classes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("lowest", "low").alias("component_id")))
    return rows.join(groups, "fingerprint").select(F.col("id").alias(key), kit.hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each group of linked rows the one with the smallest key, then text, stays.

    Rows are told apart by their fingerprints, not by their keys, which may be repeated or null; null keys come last.
    """
    from pyspark.sql import Window

    marked = fingerprints(df, text, "_fingerprint")
    classes = kit.cut(_spread(fingerprints(df.select(F.col(text).alias("t")), "t").groupBy("fingerprint").count()))
    of = classes.join(grouped(classes.select("fingerprint")), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    crowded = of.groupBy("component").agg(F.sum("count").alias("rows")).where("rows > 1").select("component")
    crowded = kit.cut(of.join(crowded, "component").select(F.col("fingerprint").alias("_of"), F.col("component").alias("_component")))
    alone = marked.join(crowded, marked["_fingerprint"] == crowded["_of"], "left_anti").drop("_fingerprint")
    rank = F.row_number().over(Window.partitionBy("_component").orderBy(F.col(key).asc_nulls_last(), F.col(text)))
    first = marked.join(crowded, marked["_fingerprint"] == crowded["_of"]).withColumn("_rank", rank).where("_rank = 1")
    return alone.unionByName(first.drop("_fingerprint", "_of", "_component", "_rank"))
