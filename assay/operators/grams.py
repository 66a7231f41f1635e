"""Word n-grams as pairs of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes of n-grams that are shipped to every task; of more, all n-grams of the texts are given.
SHIPPED = 500_000
#: Words whose n-grams are made at once.
SLICE = 1 << 18


def hashed(df: DataFrame, key: str, text: str, n: int, among: DataFrame | None = None, shipped: int = SHIPPED) -> DataFrame:
    """(key, h, g): the n-grams of the words between single spaces of each lowered text, each once a row.

    Words are hashed once each, and an n-gram's hashes are sums of its words' by odd factors of their places. Texts of fewer
    words and null texts have none. `among` holds n-grams (h, g) that are asked for: if they are few, others are left out by h
    before anything is joined, which a join must still settle.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    factors = rng.integers(0, 1 << 64, size=(2, n), dtype=np.uint64) | np.uint64(1)
    asked = None
    if among is not None:
        few = [r[0] for r in among.select("h").distinct().limit(shipped + 1).collect()]
        asked = np.sort(np.array(few, dtype=np.int64)) if len(few) <= shipped else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            words = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
            first = 0
            while first < batch.num_rows:  # whole rows of about SLICE words
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
                mine, at = words[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
                row = np.repeat(np.arange(first, last), np.diff(at))
                count = len(mine) - n + 1
                start = np.flatnonzero(row[:count] == row[n - 1 :]) if count > 0 else np.zeros(0, dtype=np.int64)
                sums = lambda by: sum((mine[j : j + count] * by[j] for j in range(n)), np.zeros(max(count, 0), dtype=np.uint64)) if count > 0 else mine[:0]
                h = sums(factors[0]).view(np.int64)[start]
                if asked is not None:
                    kept = np.isin(h, asked)
                    start, h = start[kept], h[kept]
                g = sums(factors[1]).view(np.int64)[start] if len(start) else h
                once = np.unique(np.stack([row[start], h, g], axis=1), axis=0) if len(start) else np.zeros((0, 3), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(once[:, 0])), pa.array(once[:, 1]), pa.array(once[:, 2])], names=[key, "h", "g"])
                first = last

    words = df.select(key, F.split(F.lower(text), " ").alias("_w")).where(F.size("_w") >= n).select(key, F.transform("_w", lambda w: F.xxhash64(w)).alias("_w"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("g", T.LongType())])
    return words.mapInArrow(run, schema)
