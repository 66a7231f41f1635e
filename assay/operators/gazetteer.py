"""Building a gazetteer of place names from several sources, and finding its names in texts.

Cases: rows without a name are left out; names that are cleaned to fewer than three code points, to more than two words, to
a common word or to something with Latin letters, digits or `.()` are left out; of equal names the first source wins, and
within it the first row by (en, item); null and empty texts hold no names; an empty gazetteer finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import devanagari as dv

# Common words that are no names here, and administrative words at the end of names.
STOP = """भारत हिन्दी नगर गाँव गांव पुर सिंह राम शहर देश राज्य सरकार मंदिर नदी पहाड़
गया बना बनी सात जाना डाल खेती साल खेत खाली कहना जाल काली खान सिल कुई गाडी
मंडी उना सीम प्यारा बेह भारतीय मन बाद नई नया पानी कला माल बाग भाग सेवा खेड़ा
तला टीला रानी राजा लाल सोना काला नाला ताल गढ़ पट्टी टोला कोट बारी हार जीत""".split()
SUFFIXES = ["जिला", "ज़िला", "तहसील", "नगर पालिका", "नगर निगम", "ब्लॉक", "विकासखंड"]
SUFFIXES_EN = ["district", "tehsil", "block", "municipality", "nagar panchayat"]
LETTER = "ऀ-ॿ"
#: Names that are shipped to every task; more of them are joined.
SHIPPED = 100_000


def cleaned(hi: Column) -> Column:
    """The part before a comma without an administrative word at its end."""
    return F.trim(F.regexp_replace(F.split_part(F.trim(dv.nfc(hi)), F.lit(","), F.lit(1)), rf"\s*({'|'.join(SUFFIXES)})$", ""))


def cleaned_en(en: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(dv.nfc(F.coalesce(en, F.lit("")))), rf"(?i)\s+({'|'.join(SUFFIXES_EN)})$", ""))


def build(sources: list[tuple[str, DataFrame]], common: DataFrame | None = None, shortest: int = 3) -> DataFrame:
    """(name, en, item, src, ambiguous) from tables of hi, en, item in their order of precedence. common: word."""
    every = None
    for place, (src, rows) in enumerate(sources):
        rows = rows.where("hi <> ''").select(cleaned(F.col("hi")).alias("name"), cleaned_en(F.col("en")).alias("en"), F.substring_index("item", "/", -1).alias("item"), F.lit(src).alias("src"), F.lit(place).alias("_place"))
        every = rows if every is None else every.unionByName(rows)
    fits = (F.length("name") >= shortest) & (F.size(F.split("name", r"\s+")) <= 2) & ~F.col("name").isin(*STOP) & ~F.col("name").rlike("[A-Za-z0-9.()]")
    once = every.where(fits).groupBy("name").agg(F.min_by(F.struct("en", "item", "src"), F.struct("_place", "en", "item")).alias("x")).select("name", "x.*")
    if common is None:
        return once.withColumn("ambiguous", F.lit(False))
    words = common.select(F.col("word").alias("name")).distinct().withColumn("_known", F.lit(True))
    return once.join(words, "name", "left").withColumn("ambiguous", F.col("_known").isNotNull()).drop("_known")


def occurrences(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", letter: str = LETTER, shipped: int = SHIPPED) -> DataFrame:
    """(key, name, start, end) of names in texts: from the left, the longest first, not overlapping, not within a run of letters.

    Names of letters alone can only be whole runs; the others are looked for in windows of their lengths between the edges of
    runs. Up to `shipped` names go to every task, which leaves out what is no name and what overlaps. Of more names, all runs
    and windows of a fitting length join the names, so the gazetteer may be of any size. key must name a row. Places are code
    points, end exclusive.
    """
    wanted = names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()
    few = [r[0] for r in wanted.limit(shipped + 1).collect()]
    known = frozenset(few) if len(few) <= shipped else None
    solid = ~F.col("name").rlike(f"[^{letter}]")
    sizes = {(len(n), not re.search(f"[^{letter}]", n)) for n in known} if known is not None else {tuple(r) for r in wanted.select(F.length("name"), solid).distinct().collect()}  # few: names are short
    runs_of, lengths = frozenset(n for n, whole in sizes if whole), sorted((n for n, whole in sizes if not whole), reverse=True)
    firsts = None if known is None else frozenset(n[0] for n in known if re.search(f"[^{letter}]", n))
    run, inside = re.compile(f"[{letter}]+"), re.compile(f"[{letter}]")

    def held(t: str) -> list[tuple[int, str]]:
        fits = (lambda w: len(w) in runs_of) if known is None else known.__contains__
        found = [(m.start(), m.group()) for m in run.finditer(t) if fits(m.group())] if runs_of else []
        if lengths:
            within = [bool(inside.match(c)) for c in t]
            starts = [i for i in range(len(t)) if (i == 0 or not within[i - 1]) and (firsts is None or t[i] in firsts)]
            windows = ((i, t[i : i + n]) for i in starts for n in lengths if i + n <= len(t) and not (i + n < len(t) and within[i + n]))
            found += [(i, w) for i, w in windows if (known is None or w in known) and not run.fullmatch(w)]
        return found

    def taken(found: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
        end = 0
        for i, w in sorted(found, key=lambda x: (x[0], -len(x[1]))):
            if i >= end:
                end = i + len(w)
                yield i, w

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column(0), []
            for row, t in enumerate(batch.column(1).to_pylist()):
                mine = held(t or "")
                found += [(row, i, w) for i, w in (mine if known is None else taken(mine))]
                if len(found) > 50_000:
                    yield _batch(keys, found)
                    found = []
            yield _batch(keys, found)

    def _batch(keys: pa.Array, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        rows, starts, held = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(held, pa.string())], names=["key", "start", "name"])

    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.IntegerType()), T.StructField("name", T.StringType())])
    hits = texts.select(F.col(key), F.col(text)).mapInArrow(windows, schema)
    if known is not None:
        return hits.select(F.col("key").alias(key), "name", "start", (F.col("start") + F.length("name")).alias("end"))
    hits = hits.join(wanted, "name")
    listed = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (-F.length("name")).alias("n"), "name"))).alias("x"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,n:int,name:string>>").alias("taken"))
    step = lambda acc, h: F.when(h["start"] >= acc["end"], F.struct((h["start"] - h["n"]).alias("end"), F.array_append(acc["taken"], h).alias("taken"))).otherwise(acc)
    taken = listed.select("key", F.inline(F.aggregate("x", empty, step, lambda acc: acc["taken"])))
    return taken.select(F.col("key").alias(key), "name", "start", (F.col("start") - F.col("n")).alias("end"))
