"""Reports over occurrences and recognisers: how much each name yields, what a column holds, how good single clips and votes are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import ranking
from assay.operators.vote import voted

THRESHOLDS = (3, 5, 10)


def corpora(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union of the hits of several corpora, each row with its corpus. Columns that a corpus lacks are null."""
    every = None
    for name, rows in parts:
        rows = rows.withColumn("corpus", F.lit(name))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    return every


def by_corpus(hits: DataFrame) -> DataFrame:
    """(name, corpus, n, speakers): the nested counter."""
    return hits.groupBy("name", "corpus").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))


def yields(hits: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(what, n): names heard, unambiguous ones of at least `longest` letters, and how many of those reach each threshold."""
    total = hits.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))
    told = total.join(names.select("name", "ambiguous"), "name")
    clear = ~F.col("ambiguous") & (F.length("name") >= longest)
    counts = [("names", F.count("*")), ("unambiguous", F.count_if(clear)), *((f"at least {k}", F.count_if(clear & (F.col("n") >= k))) for k in THRESHOLDS), ("speakers at least 3", F.count_if(clear & (F.col("speakers") >= 3)))]
    row = told.agg(*[c.alias(str(i)) for i, (_, c) in enumerate(counts)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(what).alias("what"), F.col(str(i)).alias("n")) for i, (what, _) in enumerate(counts)])))


def top_names(hits: DataFrame, k: int) -> DataFrame:
    """(name, n) of the k most frequent names, equal ones by name."""
    return hits.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def probe(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each column, from one pass; equal ones by value."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = ranking.top_k(counts.withColumn("_order", F.col("n")), ["column"], [F.desc("n"), F.asc_nulls_last("value")], k)
    return ranked.drop("_order")


def _judged(hyps: DataFrame) -> DataFrame:
    """(word, e, r, n, best): sums of errors and of exact texts, clips and the least error of each word. hyps: word, seq, text."""
    judged = hyps.withColumn("error", text.error_rate(F.col("text"), F.col("word"))).withColumn("right", text.same_word(F.col("text"), F.col("word")).cast("int"))
    return judged.groupBy("word").agg(F.sum("error").alias("e"), F.sum("right").alias("r"), F.count("*").alias("n"), F.min("error").alias("best"))


def errors(hyps: DataFrame) -> DataFrame:
    """One row: mean error of clips, share of exact clips, mean error of the best clip of a word."""
    return _judged(hyps).agg((F.sum("e") / F.sum("n")).alias("clip_error"), (F.sum("r") / F.sum("n")).alias("clip_exact"), F.avg("best").alias("best_clip_error"))


def votes(hyps: DataFrame) -> DataFrame:
    """One row: mean error of the vote of each word and share of exact votes. The vote is unweighted, over texts in the order of seq."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    per = hyps.groupBy("word").agg(listed.alias("texts")).withColumn("vote", voted("texts", F.transform("texts", lambda _: F.lit(1.0))))
    error = text.error_rate(F.col("vote"), F.col("word"))
    return per.agg(F.avg(error).alias("vote_error"), F.avg((error == 0).cast("int")).alias("vote_exact"))
