"""Reconciling several noisy transcripts of a name into one record, as DataFrame stages.

evidence has one row a hypothesis: case_id, clip_id, seq (order of the clip in its case), wseq (order of the hypothesis),
speaker, synthetic, snr_db, witness, text, conf. Cases are small (tens of clips) and many, so every stage is an equi join
or an aggregate on the case; names are sounded out once each, whatever the number of cases they are in. Stages that later
ones read several times are cut, so they run once and the plan's size doesn't multiply.

Decisions where the inputs are odd: only clips with text from a weighted witness are usable; a case without any gets a row
with an error; ties always go to what came first (seq); the best text of a clip may be empty only if `skip_empty_best` is off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import devanagari as dv
from assay.functions import phonology
from assay.operators import ranking
from assay.operators.vote import voted
from assay.sources.shared import cut

WITNESS_WEIGHTS = {"vakyansh": 1.0, "indicw2v": 0.8}
SUPPORTS = 0.55
EVIDENCE = "case_id long, clip_id string, seq long, wseq int, speaker string, synthetic boolean, snr_db double, witness string, text string, conf double"


def clip_weights(hyps: DataFrame) -> DataFrame:
    """(case_id, clip_id, seq, speaker, synthetic, weight, best) of every clip; hyps hold weighted witnesses only."""
    quality = 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce("snr_db", F.lit(20.0)) - 5) / 20))
    per = hyps.groupBy("case_id", "clip_id").agg(
        F.min("seq").alias("seq"), F.first("speaker").alias("speaker"), F.bool_or(F.coalesce("synthetic", F.lit(False))).alias("synthetic"), F.avg("conf").alias("conf"), F.first(quality).alias("quality"),
        F.max_by("norm", F.struct("conf", -F.col("wseq"))).alias("best"), F.max_by("norm", F.struct((F.col("norm") != "").cast("int"), "conf", -F.col("wseq"))).alias("best_full"), F.bool_or(F.col("norm") != "").alias("usable"),
    )
    weight = F.coalesce("conf", F.lit(0.3)) * F.col("quality") * F.when(F.col("synthetic"), 0.4).otherwise(1.0)
    return per.where("usable").select("case_id", "clip_id", "seq", "speaker", "synthetic", weight.alias("weight"), "best", "best_full")


def sounded(names: DataFrame, name: str) -> DataFrame:
    """(name, phones, ipa, scheme, diacritic) of each distinct name."""
    return names.select(name).distinct().withColumn("_s", phonology.sound(name)).select(name, "_s.*")


def neighbours(candidates: DataFrame, gazetteer: DataFrame, most: float = 0.3, k: int = 3) -> DataFrame:
    """(case_id, text, rank): gazetteer names near the first four candidates of a case, within blocks of the first phone."""
    first = candidates.where("place <= 4")
    blocks = candidates.select("case_id", F.get("phones", F.lit(0)).alias("block")).distinct()
    gaz = gazetteer.select("name", F.col("phones").alias("gphones"), F.get("phones", F.lit(0)).alias("block"))
    pairs = blocks.join(gaz, "block").join(first.select("case_id", "phones"), "case_id")
    # A gap costs half at least, so lengths that differ much can't be near.
    n = lambda c: F.size(F.filter(c, lambda p: p != " "))
    pairs = pairs.where(0.5 * F.abs(n(F.col("gphones")) - n(F.col("phones"))) <= most * F.greatest(n(F.col("gphones")), n(F.col("phones"))))
    near = pairs.withColumn("d", phonology.phone_distance("gphones", "phones")).groupBy("case_id", "name").agg(F.min("d").alias("d")).where(F.col("d") <= most)
    order = W.partitionBy("case_id").orderBy("d", "name")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("case_id", F.col("name").alias("text"), "rank")


def _candidates(hyps: DataFrame, votes: DataFrame, existing: DataFrame | None, gazetteer: DataFrame | None) -> DataFrame:
    """(case_id, text, origin, place, phones), the first origin of a text wins."""
    spark = hyps.sparkSession
    # Places are pairs: a number made of seq and wseq would overflow where a table numbers its clips throughout.
    row = lambda df, text, origin, p, s, w=F.lit(0): df.select("case_id", F.col(text).alias("text"), F.lit(origin).alias("origin"), F.lit(p).alias("p"), F.struct(s.cast("long").alias("s"), w.cast("long").alias("w")).alias("s"))
    found = row(hyps.where("norm <> ''"), "norm", "witness", 0, F.col("seq"), F.col("wseq")).unionByName(row(votes.where("voted <> ''"), "voted", "vote", 1, F.lit(0)))
    if existing is not None:
        found = found.unionByName(row(existing.withColumn("n", dv.normalise(F.col("hi"))).where("n <> ''").join(votes, "case_id", "left_semi"), "n", "existing", 2, F.lit(0)))

    def numbered(df: DataFrame) -> DataFrame:
        once = df.groupBy("case_id", "text").agg(F.min(F.struct("p", "s", "origin")).alias("x"))
        order = W.partitionBy("case_id").orderBy("x.p", "x.s")
        return once.select("case_id", "text", F.col("x.origin").alias("origin"), F.row_number().over(order).alias("place"))

    first = cut(numbered(found))
    first = cut(first.join(sounded(first, "text").select("text", "phones"), "text"))
    if gazetteer is None:
        return first
    names = gazetteer.select(dv.normalise(F.col("name")).alias("name")).distinct()
    near = neighbours(first, sounded(names, "name"))
    every = cut(numbered(found.unionByName(row(near, "text", "gazetteer", 3, F.col("rank")))))
    return cut(every.join(sounded(every, "text").select("text", "phones"), "text"))


def score(candidates: DataFrame, hyps: DataFrame, clips: DataFrame) -> DataFrame:
    """Support of each candidate: weighted mean over clips of exp(-4 x mean distance to the clip's hypotheses)."""
    heard = hyps.where("norm <> ''").select("case_id", "clip_id", "norm", "ww")
    heard = heard.join(sounded(heard, "norm").select("norm", F.col("phones").alias("hphones")), "norm")
    pairs = cut(candidates.select("case_id", "text", "phones").join(heard, "case_id"))
    distinct = pairs.select("text", "norm", "phones", "hphones").distinct().withColumn("d", phonology.phone_distance("phones", "hphones")).select("text", "norm", "d")
    per_clip = pairs.select("case_id", "text", "norm", "clip_id", "ww").join(distinct, ["text", "norm"]).groupBy("case_id", "text", "clip_id").agg((F.sum(F.col("ww") * F.col("d")) / F.sum("ww")).alias("d"))
    sims = per_clip.join(clips.select("case_id", "clip_id", "seq", "weight"), ["case_id", "clip_id"]).withColumn("sim", F.exp(-4.0 * F.col("d")))
    total = F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0))
    by = sims.groupBy("case_id", "text").agg(F.round(F.sum(F.col("weight") * F.col("sim")) / total, 4).alias("support"), F.sort_array(F.collect_list(F.struct("seq", "clip_id", "sim"))).alias("x"))
    return candidates.join(by, ["case_id", "text"]).select(
        "case_id", "text", "origin", "place", "support", F.transform(F.filter("x", lambda s: s["sim"] >= SUPPORTS), lambda s: s["clip_id"]).alias("supporters"),
        F.map_from_entries(F.transform("x", lambda s: F.struct(s["clip_id"], F.round(s["sim"], 3)))).alias("sims"),
    )


def merge_spacing(scored: DataFrame, clips: DataFrame) -> DataFrame:
    """Candidates that differ in spaces alone become one: the best support, the record's spelling or else the most frequent."""
    used = clips.groupBy("case_id", F.col("best").alias("text")).agg(F.count("*").alias("used"))
    record = F.col("origin").isin("existing", "gazetteer")
    prefer = F.struct(record.cast("int"), F.when(record, 0).otherwise(F.coalesce("used", F.lit(0))), -F.col("place"))
    best = F.max_by(F.struct("support", "supporters", "sims"), F.struct("support", -F.col("place"))).alias("b")
    merged = scored.join(used, ["case_id", "text"], "left").groupBy("case_id", F.replace("text", F.lit(" "), F.lit("")).alias("bare")).agg(F.max_by(F.struct("text", "origin"), prefer).alias("t"), best, F.min("place").alias("place"))
    return merged.select("case_id", "t.text", "t.origin", "place", "b.support", "b.supporters", "b.sims")


def confidence(support: Column, agree: Column, margin: Column, speakers: Column, weight: Column) -> Column:
    raw = 100 * (0.40 * support + 0.25 * agree + 0.15 * F.least(F.lit(1.0), 3 * margin) + 0.10 * F.least(F.lit(1.0), speakers / 5) + 0.10 * weight)
    return F.least(raw, F.when(speakers == 0, 40).when(speakers == 1, 54).when(speakers == 2, 70).otherwise(100))


def romanised(df: DataFrame, name: str, existing_en: str, exceptions: DataFrame | None) -> Column:
    """struct(scheme, scheme_diacritic, recommended, kind, reason) from scheme, diacritic and the exception joined as _form, _reason."""
    given = F.trim(F.coalesce(F.col(existing_en), F.lit("")))
    bare = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    differs = (given != "") & (bare(given) != bare(F.col("scheme")))
    kept = F.concat(F.lit('existing record uses "'), given, F.lit('"; the scheme would give "'), F.col("scheme"), F.lit('"'))
    return F.struct(
        "scheme", F.col("diacritic").alias("scheme_diacritic"), F.coalesce("_form", F.when(differs, given), "scheme").alias("recommended"),
        F.when(F.col("_form").isNotNull() | differs, "established").otherwise("scheme").alias("kind"), F.coalesce("_reason", F.when(differs, kept), F.lit("rendering of the consensus pronunciation")).alias("reason"),
    )


def reconcile(evidence: DataFrame, existing: DataFrame | None = None, gazetteer: DataFrame | None = None, exceptions: DataFrame | None = None, skip_empty_best: bool = False, weights: dict[str, float] = WITNESS_WEIGHTS) -> DataFrame:
    """One record a case. existing: case_id, hi, en. gazetteer: name. exceptions: name, form, reason."""
    spark = evidence.sparkSession
    ww = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hyps = cut(evidence.where(F.col("witness").isin(*weights)).withColumn("norm", dv.normalise(F.col("text"))).withColumn("ww", F.element_at(ww, F.col("witness"))))
    clips = clip_weights(hyps)
    clips = cut(clips.withColumn("best", F.col("best_full" if skip_empty_best else "best")).withColumn("key", dv.match_key(F.col("best"))))
    hyps = hyps.join(clips.select("case_id", "clip_id"), ["case_id", "clip_id"], "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "best", "weight")))
    votes = cut(clips.groupBy("case_id").agg(ordered.alias("x")).select("case_id", dv.normalise(voted(F.col("x.best"), F.col("x.weight"))).alias("voted")))
    ranked = merge_spacing(score(_candidates(hyps, votes, existing, gazetteer), hyps, clips), clips)
    order = W.partitionBy("case_id").orderBy(F.desc("support"), "place")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("support", 1, 0.0).over(order))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", "text", "origin", "support", "supporters", F.map_entries("sims").alias("s"))))), lambda c: F.struct(c["text"].alias("text"), c["origin"].alias("origin"), c["support"].alias("support"), c["supporters"].alias("supporters"), F.map_from_entries(c["s"]).alias("sims")))
    top = ranked.groupBy("case_id").agg(F.min_by(F.struct("text", "support", (F.col("support") - F.col("second")).alias("margin")), "rank").alias("top"), listed.alias("candidates"))
    top = cut(top.withColumn("devanagari", F.col("top.text")).withColumn("top_key", dv.match_key(F.col("devanagari"))))
    who = F.when(~F.col("synthetic"), F.coalesce(F.nullif("speaker", F.lit("")), "clip_id"))
    total = F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0))
    judged = cut(clips.join(top.select("case_id", "top_key"), "case_id"))
    facts = judged.groupBy("case_id").agg(
        (F.sum(F.when(F.col("key") == F.col("top_key"), F.col("weight")).otherwise(0.0)) / total).alias("agree"), F.countDistinct(who).alias("speakers"), F.count("*").alias("clips"), F.avg("weight").alias("mean_weight"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "best"))), lambda s: s["best"]).alias("per_clip_best"), total.alias("total"),
    )
    groups = judged.where("key <> top_key").groupBy("case_id", "key").agg(ordered.alias("x"), F.sum("weight").alias("w"), F.countDistinct(who).alias("speakers"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "clip_id"))), lambda s: s["clip_id"]).alias("clips"))
    groups = cut(groups.where("speakers >= 2").withColumn("text", dv.normalise(voted(F.col("x.best"), F.col("x.weight")))))
    tops = cut(sounded(top, "devanagari"))
    variants = groups.join(sounded(groups, "text"), "text").join(top.select("case_id", "devanagari"), "case_id").join(tops.select("devanagari", F.col("phones").alias("tp")), "devanagari")
    variants = variants.where(phonology.phone_distance("tp", "phones") >= 0.04).join(facts.select("case_id", "total"), "case_id")
    nested = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), F.element_at("x.seq", 1).alias("f"), F.struct(F.col("text").alias("devanagari"), "ipa", F.col("scheme").alias("roman"), "clips", "speakers", F.round(F.col("w") / F.col("total"), 3).alias("share")).alias("v"))))
    variants = variants.groupBy("case_id").agg(F.transform(nested, lambda s: s["v"]).alias("variants"))
    out = top.join(facts, "case_id").join(tops, "devanagari").join(variants, "case_id", "left")
    known = existing if existing is not None else spark.createDataFrame([], "case_id long, hi string, en string")
    out = out.join(known.select("case_id", dv.normalise(F.col("hi")).alias("_hi"), F.col("en").alias("_en")), "case_id", "left")
    if gazetteer is not None:
        out = out.join(gazetteer.select(dv.normalise(F.col("name")).alias("devanagari")).distinct().withColumn("_in", F.lit(True)), "devanagari", "left")
    else:
        out = out.withColumn("_in", F.lit(False))
    if exceptions is not None:
        out = out.join(exceptions.select(dv.normalise(F.col("name")).alias("devanagari"), F.col("form").alias("_form"), F.col("reason").alias("_reason")), "devanagari", "left")
    else:
        out = out.withColumn("_form", F.lit(None).cast("string")).withColumn("_reason", F.lit(None).cast("string"))
    match = F.coalesce("_in", F.lit(False)) | F.coalesce(F.col("_hi") == F.col("devanagari"), F.lit(False))
    points = confidence(F.col("top.support"), F.col("agree"), F.col("top.margin"), F.col("speakers"), F.col("mean_weight"))
    some = F.coalesce(F.size("variants"), F.lit(0))
    flags = F.array_compact(F.array(
        F.when(F.col("speakers") < 3, "needs more recordings (fewer than 3 real speakers)"), F.when(F.col("agree") < 0.6, "speakers disagree"), F.when(~match, "no matching existing record"),
        F.when(some > 0, F.concat(some.cast("string"), F.lit(" regional variant(s) kept as linked alternates"))),
    ))
    records = out.select(
        "case_id", "devanagari", "ipa", romanised(out, "devanagari", "_en", exceptions).alias("roman"),
        F.struct(F.round(points, 1).alias("score"), ranking.band(points).alias("band"), F.col("top.support").alias("support"), F.round("agree", 3).alias("agreement"), F.round("top.margin", 3).alias("margin"), "speakers", "clips", F.round("mean_weight", 3).alias("mean_clip_weight"), match.alias("existing_match")).alias("confidence"),
        "candidates", F.coalesce("variants", F.array().cast(dict(out.dtypes)["variants"])).alias("variants"), flags.alias("flags"), "per_clip_best", F.lit(None).cast("string").alias("error"),
    )
    bad = evidence.select("case_id").distinct().join(clips.select("case_id"), "case_id", "left_anti").withColumn("error", F.lit("no usable clips"))
    return records.unionByName(bad, allowMissingColumns=True)
