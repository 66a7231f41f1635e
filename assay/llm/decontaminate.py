"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark passages are folded alike: lower case, runs of anything but letters and digits become one space. A
passage of n characters that occurs in a text with at most e edits shares at least n - q + 1 - q*e of its q-grams with
the text, and the diagonals (place in the text less place in the passage) of those differ by at most e. So shared q-grams
are counted in bands of 2(e+1) diagonals that overlap by half; bands reaching the bound are kept, and a banded alignment
with free ends in the text verifies them. The budget e is `budget` of the passage, less where the bound would not be positive.

The benchmark is searched in parts of at most `PART_CHARS` characters and a passage, one after another: an index is built and
shipped, the documents pass it, and the matches so far are written to the shared folder before the next. So neither driver nor
task holds more than one part, whatever the benchmark's size. A text's shared q-grams are counted in windows with at most
about `HITS` of them, which overlap by the longest passage and its edits; so a q-gram that many passages share costs time, and
no memory in proportion.

Cases: null or empty passages match nothing; passages under q folded characters are searched exactly as whole words; a null
or empty text has no match; texts of any length are read whole; equal passages are all reported; ids of passages may be of any
type and are reported as text, passages without one aren't searched; ties among ends go to the first; repeated rows get the
same answer; columns named like the results are replaced; an empty benchmark or table works.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

Q = 8
BUDGET = 0.1
PART_CHARS = 4_000_000
HITS = 2_000_000
RESULTS = ("n_matches", "contaminated", "matches")
#: Cells of the first filter for each q-gram of the benchmark.
FILTER_CELLS = 32
_PRIME = 0x100000001B3


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the place of each in the text."""
    raw, _ = kit.code_points([text])
    return _fold(raw[:-1])


def _fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As fold(). Zeros end texts and stay."""
    low = kit.folded()[raw]
    low[raw == 0] = 0
    space = low == 32
    drop = space[1:] & (space[:-1] | (low[:-1] == 0))
    at = np.flatnonzero(~np.append(space[:1], drop))
    return low[at], at


def _grams(c: np.ndarray, q: int, kind: type) -> np.ndarray:
    """A rolling hash of every q code points: those of 1, 2, 4 .. are doubled, and put together to q."""
    prime, part, size = kind(_PRIME & np.iinfo(kind).max), c.astype(kind), 1
    out, have = None, 0
    n = max(len(c) - q + 1, 0)
    power = prime
    while True:
        if q & size:
            out = part[have : have + n].copy() if out is None else out * power + part[have : have + n]
            have += size
        if have == q:
            return out
        part = part[:-size] * power + part[size:] if len(part) > size else part[:0]
        size, power = 2 * size, power * power


@dataclass
class Index:
    items: list[str]
    codes: list[np.ndarray]
    q: int = Q
    edits: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def __post_init__(self) -> None:
        every = [(c, i) for i, c in enumerate(self.codes) if len(c) >= self.q]
        with np.errstate(over="ignore"):
            grams = np.concatenate([_grams(c, self.q, np.uint64) for c, _ in every] or [np.zeros(0, np.uint64)])
            short = np.concatenate([_grams(c, self.q, np.uint32) for c, _ in every] or [np.zeros(0, np.uint32)])
        item = np.concatenate([np.full(len(c) - self.q + 1, i) for c, i in every] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(c) - self.q + 1) for c, _ in every] or [np.zeros(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.keys, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.item, self.place = item[order], place[order]
        self.shift = np.uint32(32 - min(max((FILTER_CELLS * len(self.keys)).bit_length(), 10), 28))
        self.filter = np.zeros(1 << (32 - int(self.shift)), dtype=bool)
        self.filter[self._cell(short)] = True
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.short = [(i, c) for i, c in enumerate(self.codes) if 0 < len(c) < self.q]

    def _cell(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(0x9E3779B1)) >> self.shift

    def found(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in c of q-grams of the benchmark and their numbers: a filter over short hashes first, then the full hashes."""
        if not len(self.keys) or len(c) < self.q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.filter[self._cell(_grams(c, self.q, np.uint32))])
            grams = _grams(c[at[:, None] + np.arange(self.q)].reshape(-1), self.q, np.uint64)[:: self.q]
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        same = self.keys[k] == grams
        return at[same], k[same]

    def windows(self, at: np.ndarray, k: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and postings, in windows of about `most` of them that share the places a passage and its edits may span."""
        n = self.starts[k + 1] - self.starts[k]
        ends = np.cumsum(n)
        span = int((self.sizes + self.edits).max(initial=0)) + 1
        begin = 0
        while begin < len(at):
            reach = int(np.searchsorted(ends, ends[begin] - n[begin] + most, side="right"))
            end = max(reach, int(np.searchsorted(at, at[begin] + 2 * span)))  # twice the span, so that each window gets on
            m = n[begin:end]
            posting = np.repeat(self.starts[k[begin:end]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(at[begin:end], m), posting
            begin = len(at) if end >= len(at) else int(np.searchsorted(at, at[end] - span))


def build(items: list[tuple[object, str | None]], q: int = Q, budget: float = BUDGET) -> Index:
    ids, codes = [], []
    for i, text in items:
        c, _ = fold(text or "")
        if len(c) and c[-1] == 32:
            c = c[:-1]
        if len(c) and c[0] == 32:
            c = c[1:]
        if i is not None and len(c):
            ids.append(str(i))
            codes.append(c)
    n = np.array([len(c) for c in codes], dtype=np.int64)
    edits = np.maximum(np.minimum((budget * n).astype(np.int64), (n - q) // q), 0)
    return Index(ids, codes, q, edits, np.maximum(n - q + 1 - q * edits, 1))


def _align(text: np.ndarray, base: np.ndarray, width: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern within its band and the offset in the band where the alignment ends.

    base: place in the text of the band's first diagonal. free: the offsets at which an alignment may begin.
    """
    n, most = len(base), int(width.max())
    offset = np.arange(most, dtype=np.int32)
    big = np.int32(1 << 20)
    within = offset[None, :] < width[:, None]
    dist = np.where(free & within, np.int32(0), big)
    done, where = np.full(n, big), np.zeros(n, dtype=np.int64)
    # All bands go on to the longest pattern's end.
    pad = int(max(-base.min(), 0, (base + width).max() + sizes.max() - len(text))) + 1
    padded = np.concatenate([np.full(pad, 0xFFFFFFFD, np.uint32), text, np.full(pad, 0xFFFFFFFD, np.uint32)])
    at = base[:, None] + offset + pad
    at[~within] = 0
    skip = np.full((n, most), big, dtype=np.int32)
    for i in range(int(sizes.max())):
        skip[:, :-1] = dist[:, 1:] + 1
        dist += padded[at] != patterns[:, i, None]
        np.minimum(dist, skip, out=dist)
        dist -= offset
        np.minimum.accumulate(dist, axis=1, out=dist)
        dist += offset
        dist[~within] = big
        at += within
        ends = np.flatnonzero(sizes == i + 1)
        if len(ends):
            first = dist[ends].argmin(axis=1)
            done[ends], where[ends] = dist[ends, first], first
    return done, where


def _bands(index: Index, hit: np.ndarray, posting: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(item, first diagonal) of the bands whose shared q-grams reach the bound."""
    item = index.item[posting]
    diagonal = hit - index.place[posting]
    half = index.edits[item] + 1
    items = len(index.items)
    out = []
    for shift in (0, 1):
        # A count by hashed key is never less than the count by key, so this drops only what is under the bound.
        key = ((diagonal + shift * half) // (2 * half)) * items + item
        cells = (1 << max(len(key).bit_length() + 1, 8)) - 1
        hashed = (key * 0x9E3779B97F4A7C1 >> 20) & cells
        key = key[np.bincount(hashed, minlength=cells + 1)[hashed] >= index.least[item]]
        key, n = np.unique(key, return_counts=True)
        b, i = key // items, key % items
        enough = n >= index.least[i]
        i, b = i[enough], b[enough]
        w = index.edits[i] + 1
        out.append((i, b * 2 * w - shift * w))
    return out


def search(texts: list[str], index: Index, hits: int = HITS) -> list[list[tuple[int, int, int, int]]]:
    """(number of the passage, start, end, edits) of every match of each text, in code points, by start."""
    raw, starts = kit.code_points(texts)
    c, at = _fold(raw)
    found: set[tuple[int, int, int, int]] = set()
    bands = [band for hit, posting in index.windows(*index.found(c), hits) for band in _bands(index, hit, posting)]
    if bands:
        both = np.concatenate([np.stack(band) for band in bands], axis=1)
        item, base = np.unique(both, axis=1) if len(bands) > 2 else both  # windows that overlap may find a band twice
        width = 2 * (index.edits[item] + 1)
        for s in range(0, len(item), 4096):
            found.update(_verify(c, index, item[s : s + 4096], base[s : s + 4096], width[s : s + 4096]))
    for i, p in index.short:
        found.update((i, s, s + len(p), 0) for s in _whole_words(c, p))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for i, s, e, d in found:
        t = int(np.searchsorted(starts, at[s], side="right")) - 1
        out[t].append((int(i), int(at[s] - starts[t]), int(at[e - 1] + 1 - starts[t]), d))
    return [sorted(x, key=lambda m: (m[1], m[0], m[2], m[3])) for x in out]


def _verify(c: np.ndarray, index: Index, item: np.ndarray, base: np.ndarray, width: np.ndarray) -> list[tuple[int, int, int, int]]:
    sizes, edits = np.array([len(index.codes[i]) for i in item]), index.edits[item]
    patterns = np.full((len(item), int(sizes.max())), 0xFFFFFFFF, dtype=np.uint32)
    for k, i in enumerate(item):
        patterns[k, : sizes[k]] = index.codes[i]
    text = np.where(c == 0, np.uint32(0xFFFFFFFE), c)
    slack = edits  # insertions may leave the band that the q-grams span
    dist, where = _align(text, base - slack, width + 2 * slack, patterns, sizes, np.ones((len(item), int((width + 2 * slack).max())), dtype=bool))
    good = np.flatnonzero(dist <= edits)
    if not len(good):
        return []
    item, sizes, edits, dist, patterns = item[good], sizes[good], edits[good], dist[good], patterns[good]
    end = base[good] - slack[good] + where[good] + sizes  # exclusive
    back = np.full_like(patterns, 0xFFFFFFFF)
    for k in range(len(item)):
        back[k, : sizes[k]] = patterns[k, : sizes[k]][::-1]
    base2 = (len(text) - end) - edits
    width2 = 2 * edits + 1
    free = np.arange(int(width2.max()))[None, :] == edits[:, None]
    free = free | (np.arange(free.shape[1])[None, :] >= width2[:, None])
    dist2, where2 = _align(text[::-1], base2, width2, back, sizes, free)
    start = len(text) - (base2 + where2 + sizes)
    return [(int(i), max(int(s), 0), int(e), int(d)) for i, s, e, d, d2 in zip(item, start, end, dist, dist2, strict=True) if s < e]


def _whole_words(c: np.ndarray, p: np.ndarray) -> list[int]:
    if len(c) < len(p):
        return []
    at = np.flatnonzero(np.logical_and.reduce([c[k : len(c) - len(p) + 1 + k] == x for k, x in enumerate(p)]))
    edge = lambda i: i < 0 or i >= len(c) or c[i] in (0, 32)
    return [s for s in at.tolist() if edge(s - 1) and edge(s + len(p))]


def parts(benchmark: DataFrame, item: str = "item_id", text: str = "text", q: int = Q, budget: float = BUDGET, most: int = PART_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark one by one, each over at most `most` characters and a passage; at least one."""
    rows: list[tuple[object, str | None]] = []
    size, none = 0, True
    for r in benchmark.select(item, text).where(F.col(item).isNotNull()).orderBy(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= most:
            yield build(rows, q, budget)
            rows, size, none = [], 0, False
    if rows or none:
        yield build(rows, q, budget)


MATCH = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("edits", T.IntegerType())])


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", q: int = Q, budget: float = BUDGET, most: int = PART_CHARS) -> DataFrame:
    """df with n_matches, contaminated and matches: start, end (code points, exclusive), item and edits, in this order."""
    out = df.drop(*[c for c in RESULTS if c in df.columns])
    context, columns = df.sparkSession.sparkContext, out.columns
    for number, index in enumerate(parts(benchmark, q=q, budget=budget, most=most)):
        if number:
            out = kit.cut(out)
        out = kit.append(out, [T.StructField("_new", T.ArrayType(MATCH))], text, _finder(context.broadcast(index), text))
        out = out.withColumn("_found", F.concat("_found", "_new") if number else F.col("_new")).drop("_new")
    size = F.size("_found").cast("long")
    return out.select(*columns, size.alias("n_matches"), (size > 0).alias("contaminated"), F.array_sort("_found").alias("matches"))


def _finder(shared, text: str):
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("edits", pa.int32())]))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        index = shared.value
        found = search(kit.texts_of(batch, text), index)
        return [pa.array([[{"start": s, "end": e, "item": index.items[i], "edits": d} for i, s, e, d in x] for x in found], kinds)]

    return work


def written(matches: Column) -> Column:
    """item:start:end:edits of each match, comma-joined."""
    return F.array_join(F.transform(matches, lambda m: F.concat_ws(":", m["item"], m["start"].cast("string"), m["end"].cast("string"), m["edits"].cast("string"))), ",")


def keep_clean(df: DataFrame, benchmark: DataFrame, text: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows of df without any match, as they are: columns named like the results keep their values."""
    return kit.keep(df, lambda x: find(x, benchmark, text, q=q, budget=budget), RESULTS, ~F.col("contaminated"))
