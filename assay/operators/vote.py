"""Column vote: strings are aligned to their medoid and each column takes the symbol with most weight."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(a: str, b: str) -> list[list[int]]:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def _distance(a: str, b: str) -> int:
    """Edit distance; what both begin or end with costs nothing."""
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    return _table(a, b)[-1][-1] if a and b else len(a) + len(b)


def _aligned(text: str, medoid: str) -> tuple[list[str], list[str]]:
    """What text has at each place of the medoid, and between the places. Diagonal steps are preferred, then insertions."""
    if text == medoid:
        return list(text), [""] * (len(text) + 1)
    t = _table(text, medoid)
    at, between = [""] * len(medoid), [""] * (len(medoid) + 1)
    i, j = len(text), len(medoid)
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (text[i - 1] != medoid[j - 1]):
            i, j = i - 1, j - 1
            at[j] = text[i]
        elif i and t[i][j] == t[i - 1][j] + 1:
            i -= 1
            between[j] = text[i] + between[j]
        else:
            j -= 1
    return at, between


def column_vote(texts: list[str], weights: list[float] | None = None) -> str:
    """Empty texts and their weights are left out; ties go to what was counted first."""
    pairs = [(t, w) for t, w in zip(texts, weights or [1.0] * len(texts), strict=True) if t]
    if len(pairs) < 2:
        return pairs[0][0] if pairs else ""
    counts = Counter(t for t, _ in pairs)  # by first place; equal texts are compared and aligned once
    if len(counts) == 1:
        return pairs[0][0]
    far = dict.fromkeys(counts, 0)
    for a, b in combinations(counts, 2):
        d = _distance(a, b)
        far[a] += d * counts[b]
        far[b] += d * counts[a]
    medoid = min(counts, key=far.__getitem__)
    aligned = {t: _aligned(t, medoid) for t in counts}
    at, between = [Counter() for _ in medoid], [Counter() for _ in range(len(medoid) + 1)]
    for text, weight in pairs:
        for votes, symbols in zip((at, between), aligned[text], strict=True):
            for column, symbol in zip(votes, symbols, strict=True):
                column[symbol] += weight
    first = lambda c: c.most_common(1)[0][0]
    return "".join(first(b) + a for b, a in zip(between, [*map(first, at), ""], strict=True))


@F.arrow_udf(T.StringType())
def voted(texts: pa.Array, weights: pa.Array) -> pa.Array:
    return pa.array([column_vote([x or "" for x in t], w) for t, w in zip(texts.to_pylist(), weights.to_pylist(), strict=True)], pa.string())
