"""Shared parts of the corpus operators: Arrow row maps, code-point tables, groups of sorted partitions."""

from __future__ import annotations

import ctypes
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.graph import Forest, components
from assay.sources.shared import cut, shared_dir

__all__ = ["Forest", "components", "cut", "shared_dir"]  # from the library's own parts

#: Texts are handled in slices of about so many code units, which bounds a Python worker's memory.
SLICE_BYTES = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together, or hold one row."""
    ends = np.cumsum(np.asarray(_lengths(batch.column(column)), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lengths(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0)


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Freed memory goes back to the system: allocators keep it otherwise, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def append(df: DataFrame, fields: list[T.StructField], column: str, work: Callable[[pa.RecordBatch], list[pa.Array]], most: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """df with the arrays that work(slice) gives as further columns. Columns of the same names are replaced.

    done() is called at a partition's end, to drop what work has kept.
    """
    base = df.drop(*[f.name for f in fields if f.name in df.columns])
    schema = T.StructType([*base.schema.fields, *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)
                release()
            batch = part = None  # else they are held while the next batch is read
        if done:
            done()
        release()

    return base.mapInArrow(run, schema)


def keep(df: DataFrame, work: Callable[[DataFrame], DataFrame], results: tuple[str, ...], where: Column) -> DataFrame:
    """The rows of df for whose results the condition holds, as they are: columns named like the results keep their values."""
    mine = {c: f"_own_{c}" for c in results if c in df.columns}
    return work(df.withColumnsRenamed(mine)).where(where).drop(*results).withColumnsRenamed({new: c for c, new in mine.items()})


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


#: Script ranges: first and last code point, by the Unicode block tables (fixed values).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


@cache
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@cache
def marks() -> np.ndarray:
    """Of each code point, whether it is a mark that belongs to the letter before it, such as a vowel sign."""
    return np.array([unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x110000)])


@cache
def folded() -> np.ndarray:
    """Of each code point, its lower case; a space for all that is neither letter nor digit."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalnum():
            out[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    return out


@cache
def scripts() -> np.ndarray:
    """Of each code point of the first plane, 1 + the place of its script in SCRIPTS; 0 for others."""
    out = np.zeros(0x10000, dtype=np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[a : b + 1] = i + 1
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a zero after each text, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of a sorted partition, dealt anew so that none splits a run of equal numeric keys, and where the runs begin.

    No more than a batch and one group is held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [np.asarray(batch[k]) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        new[0] = bool(held) and any(np.asarray(held[-1][k])[-1] != v[0] for k, v in zip(keys, values, strict=True))
        at = np.flatnonzero(new)
        if len(at):
            held.append(batch.slice(0, at[-1]))
            yield _grouped(held, keys)
            held = []
        held.append(batch.slice(at[-1]) if len(at) else batch)
    if held:
        yield _grouped(held, keys)


def _grouped(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = np.asarray(batch[k])
        new[1:] |= v[1:] != v[:-1]
    return batch, np.flatnonzero(new)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two places of the same group, for groups of few members: one step for each size."""
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        first.append((at[:, None] + i).ravel())
        second.append((at[:, None] + j).ravel())
    return np.concatenate(first), np.concatenate(second)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))
