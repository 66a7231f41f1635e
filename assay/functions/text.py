"""Text expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_any(needle: str, exact: list[str], lowered: list[str]) -> Column:
    """Substring in any column: as written in the exact ones, ignoring case in the others. An empty needle matches all."""
    if not needle:
        return F.lit(True)
    tests = [F.contains(F.col(c), F.lit(needle)) for c in exact] + [F.contains(F.lower(F.col(c)), F.lit(needle.lower())) for c in lowered]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def capitalise_words(s: Column) -> Column:
    """First letter of each word in upper case; the rest as it is."""
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def error_rate(heard: Column, truth: Column) -> Column:
    """Edit distance without spaces by the length of the truth."""
    a, b = F.replace(heard, F.lit(" "), F.lit("")), F.replace(truth, F.lit(" "), F.lit(""))
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(b))


def same_word(a: Column, b: Column) -> Column:
    """Equal but for case and spaces."""
    return F.lower(F.replace(a, F.lit(" "), F.lit(""))) == F.lower(F.replace(b, F.lit(" "), F.lit("")))
