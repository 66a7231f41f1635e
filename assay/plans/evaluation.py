"""How often the reconciled name is right: single clips, the clearest, the best, consensus, by band and by number of clips.

evidence is as in the reconciliation; truth has case_id, name. Names are equal if their match keys are. Each result is a
plain aggregate; the sweep reconciles all its samples in one plan, as cases of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import devanagari as dv
from assay.operators import reconcile as rc

SWEEP, REPEATS = (1, 2, 3, 4, 6, 8), 3


def _keyed(truth: DataFrame) -> DataFrame:
    return truth.select("case_id", dv.match_key(dv.normalise(F.col("name"))).alias("truth"))


def _right(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records with whether they are right; records without a name are wrong."""
    return records.join(_keyed(truth), "case_id").withColumn("right", F.coalesce(dv.match_key(F.col("devanagari")) == F.col("truth"), F.lit(False)).cast("int"))


def single_clips(evidence: DataFrame, truth: DataFrame) -> DataFrame:
    """(cases, clips_per_case, speakers_per_case, random, clearest, oracle): exact rates of clips on their own."""
    hyps = evidence.where(F.col("witness").isin(*rc.WITNESS_WEIGHTS)).withColumn("norm", dv.normalise(F.col("text")))
    clips = rc.clip_weights(hyps).withColumn("key", dv.match_key(F.col("best_full")))
    judged = clips.join(_keyed(truth), "case_id").withColumn("right", (F.col("key") == F.col("truth")).cast("int"))
    clearest = F.max_by("right", F.struct("weight", -F.col("seq")))
    per = judged.groupBy("case_id").agg(F.avg("right").alias("a"), F.max("right").alias("o"), clearest.alias("c"), F.count("*").alias("n"), F.countDistinct("speaker").alias("s"))
    return per.agg(F.count("*").alias("cases"), F.avg("n").alias("clips_per_case"), F.avg("s").alias("speakers_per_case"), F.avg("a").alias("random"), F.avg("c").alias("clearest"), F.avg("o").alias("oracle"))


def by_band(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(band, n, exact); band `all` is every record."""
    judged = _right(records.where("error IS NULL"), truth).select(F.col("confidence.band").alias("band"), "right")
    return judged.rollup("band").agg(F.count("*").alias("n"), F.avg("right").alias("exact")).select(F.coalesce("band", F.lit("all")).alias("band"), "n", "exact")


def samples(evidence: DataFrame, sizes: tuple[int, ...] = SWEEP, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """Evidence of k clips of each case that has so many, for every k and repeat, as new cases; _case and k name their origin."""
    draws = [(i * repeats + r, k, r) for i, k in enumerate(sizes) for r in range(repeats)]
    listed = evidence.groupBy("case_id").agg(F.collect_set(F.struct("clip_id")).alias("_c"))
    asked = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(r).alias("r")) for i, k, r in draws]), lambda d: F.size("_c") >= d["k"])
    order = lambda d: F.array_sort(F.transform("_c", lambda c: F.struct(F.sha1(F.concat_ws(":", c["clip_id"], F.lit(seed), d["k"], d["r"])), c["clip_id"].alias("clip_id"))))
    # Each case is drawn from within its row: rows of clips x draws would be sorted, and spilled, by the few tasks of a small shuffle.
    drawn = listed.select("case_id", F.inline(F.flatten(F.transform(asked, lambda d: F.transform(F.slice(order(d), 1, d["k"]), lambda c: F.struct(c["clip_id"].alias("clip_id"), d["i"].alias("i"), d["k"].alias("k")))))))
    mixed = evidence.join(drawn.hint("merge"), ["case_id", "clip_id"])
    return mixed.withColumn("_case", F.col("case_id")).withColumn("case_id", F.col("case_id") * len(draws) + F.col("i")).drop("i")


def sweep(evidence: DataFrame, truth: DataFrame, sizes: tuple[int, ...] = SWEEP, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """(k, n, exact) of consensus over k clips, on acoustic evidence alone."""
    drawn = samples(evidence, sizes, repeats, seed)
    origin = drawn.select("case_id", "_case", "k").distinct()
    truths = origin.join(truth.select(F.col("case_id").alias("_case"), "name"), "_case").select("case_id", "name")
    judged = _right(rc.reconcile(drawn.drop("_case", "k")), truths)
    return judged.join(origin.select("case_id", "k"), "case_id").groupBy("k").agg(F.count("*").alias("n"), F.avg("right").alias("exact"))
