"""Gates of recordings: which clips are kept, which hypothesis of a clip counts, how many cuts pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A clip needs so many samples, and its name located within this distance.
LEAST_SAMPLES, MOST_DISTANCE = 1_600, 0.34
#: What a sentence's recogniser heard counts up to this distance.
IN_CONTEXT = 0.5
#: Error rates up to which a cut passes.
CUT_PASSES = (0.25, 0.34)


def clip_passes(samples: Column, distance: Column) -> Column:
    """Whether a clip is kept. One that wasn't cut (null) isn't."""
    return F.coalesce((samples >= LEAST_SAMPLES) & (distance <= MOST_DISTANCE), F.lit(False))


def accepted(in_context: Column, alone: Column, distance: Column) -> Column:
    """struct(text, context): what was heard in the sentence if it was located well enough, else in the clip alone."""
    fits = F.coalesce(distance <= IN_CONTEXT, F.lit(False)) & in_context.isNotNull()
    return F.struct(F.when(fits, in_context).otherwise(alone).alias("text"), F.when(fits, "sentence").otherwise("clip").alias("context"))


def pass_rates(cuts: DataFrame, by: list[str], error: str, distance: str) -> DataFrame:
    """(by, n, located, pass_25, pass_34, mean_error) of cuts; those that weren't located count with an error of 1."""
    e = F.coalesce(F.col(error), F.lit(1.0))
    passed = [F.count_if(e <= limit).alias(f"pass_{round(100 * limit)}") for limit in CUT_PASSES]
    return cuts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(distance) <= MOST_DISTANCE, F.lit(False))).alias("located"), *passed, F.avg(e).alias("mean_error"))
