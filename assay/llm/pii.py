"""Personal data: fixed base patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Base spans come from four regular expressions. `split` gives the text between the matches and `regexp_extract_all` the
matches; running sums of their lengths are the places, in code points. The expressions are rewritten so that Java's engine
neither recurses nor starts anew inside a run (separators inside a run become a marker character first); the matches are
the same.

Bootstrapping: items are the base spans (overlapping ones as one) and, outside them, identifier-like values (six characters
with a digit, or more). Seeds are the base spans and, of the values, those with the shape of a key or digest: `SECRET`. The
patterns of an item are the word before it and the word after it, each with the signs between, in lower case and with every
digit as 0, so that numbers count by their shape; spaces, quotes, `+` and `@` don't count. Over the graph of patterns and
values, a pattern's confidence is the sum of the scores of its distinct values, divided by their number and that of all places
in the texts where the pattern is next to something else. Seeds score 1. Towards a pattern, another value scores the greatest
confidence of its other patterns that are trusted, so none vouches for itself. A pattern is trusted with a confidence of at
least `CONFIDENCE` and `SUPPORT` distinct values that score as much; so values found in one round are seeds of the next.
Rounds end when the trusted patterns stay the same, or after `ROUNDS`. Items next to a trusted pattern that are no base spans
are new spans of kind `id`; a value of a key's shape in any other place isn't. Base spans always stay.

Cases: a null text counts as empty (no spans); overlapping spans of different kinds are all reported; equal starts are in
the order of the kinds; texts of any length are read whole; rows that repeat get the same answer; empty tables work; columns
named like the results are replaced. Up to `MAX_PATTERNS` learned patterns are put into the plan; beyond that they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import kit

KINDS = ["email", "ip", "card", "phone", "id"]
ROUNDS, CONFIDENCE, SUPPORT = 10, 0.8, 3
MAX_PATTERNS = 5_000
#: Patterns that a task may hold while it counts them.
MAX_SHIPPED = 200_000
#: Stands for a separator inside a run; where it is in a text itself, it is read as a character of no class.
MARK, NEUTRAL = "\x01", "|"

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]*+"
EMAIL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]+"
CARD_GAP = r"(?<=[0-9])[ -](?=[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
VALUE = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@+][A-Za-z0-9@._%+-]{4,}[A-Za-z0-9]"
#: The shape of keys and digests: long, of letters and digits, with several of both.
SECRET = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9_-]{20,}+$"
#: Stands for an item; where it is in a text itself, it is read as a character of no class.
ITEM = "\x02"
WORD = r"[\p{L}\p{N}_-]++|\x02"
#: Signs that don't count between a word and an item.
SILENT = " \t\n\r\"'<(+@"

SPAN = "array<struct<start:int,k:int,end:int>>"


def _placed(found: Column, between: Column) -> Column:
    """array<struct<start,end,value>> of the matches, from them and the text between them; empty where they are null."""
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"), b.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value")))).alias("out"))

    return F.coalesce(F.aggregate(steps, start, add, lambda acc: acc["out"]), none)


def _matched(df: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column of places for each name, of (pattern, text or null).

    Texts, matches and gaps are columns of their own, so that each is computed once: inside higher-order functions they
    would be computed anew at every use.
    """
    df = df.withColumns({f"{name}_in": text for name, (_, text) in patterns.items()})
    steps = {}
    for name, (pattern, _) in patterns.items():
        steps[f"{name}_found"] = F.regexp_extract_all(f"{name}_in", F.lit(pattern), F.lit(0))
        steps[f"{name}_gaps"] = F.split(f"{name}_in", pattern, -1)
    df = df.withColumns(steps).withColumns({name: _placed(F.col(f"{name}_found"), F.col(f"{name}_gaps")) for name in patterns})
    return df.drop(*[f"{name}_in" for name in patterns], *steps)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum by Luhn's rule is a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).otherwise("999").cast("int") <= 255)


def _spans(found: Column, kind: str, valid=None) -> Column:
    kept = found if valid is None else F.filter(found, lambda x: valid(x["value"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end")))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _base (sorted base spans)."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(t, MARK, NEUTRAL)
    out = _matched(
        df,
        {
            "_email": (EMAIL, F.when(F.contains(t, F.lit("@")), F.regexp_replace(plain, EMAIL_DOT, MARK))),
            "_ip": (IP, F.when(t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), t)),
            "_card": (CARD, F.when(t.rlike(r"(?:[0-9][ -]?){13}[0-9]"), F.regexp_replace(plain, CARD_GAP, MARK))),
            "_phone": (PHONE, F.when(F.contains(t, F.lit("+")), t)),
        },
    )
    byte_parts = lambda v: F.forall(F.split(v, r"\."), _byte)
    card = lambda v: F.length(_digits(v)).between(14, 19) & luhn(F.when(F.length(_digits(v)).between(14, 19), _digits(v)).otherwise("0"))
    phone = lambda v: F.length(_digits(v)).between(10, 15)
    every = F.concat(_spans(F.col("_email"), "email"), _spans(F.col("_ip"), "ip", byte_parts), _spans(F.col("_card"), "card", card), _spans(F.col("_phone"), "phone", phone))
    return out.withColumn("_base", F.array_sort(every)).drop("_email", "_ip", "_card", "_phone")


def with_words(df: DataFrame, text: str = "text", every: bool = False) -> DataFrame:
    """df, which has _base, with _found (items: start, end, value, base, seed) and the words and signs around them, _words and _signs.

    Texts without items have null words and signs, unless every text is asked for.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    last = lambda acc: F.element_at(acc, -1)
    bare = lambda start, end: F.struct(start.alias("start"), end.alias("end"))

    def merge(acc: Column, s: Column) -> Column:
        joined = bare(last(acc)["start"], F.greatest(last(acc)["end"], s["end"]))
        return F.when(F.get(acc, F.size(acc) - 1)["end"] > s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(bare(s["start"], s["end"]))))

    none = F.array().cast("array<struct<start:int,end:int>>")
    base = F.aggregate("_base", none, lambda acc, s: F.when(F.size(acc) == 0, F.array(bare(s["start"], s["end"]))).otherwise(merge(acc, s)))
    out = _matched(df.withColumn("_seeds", base), {"_values": (VALUE, F.when(t.rlike("[0-9]"), t))})
    free = F.filter("_values", lambda x: ~F.exists("_seeds", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    item = lambda x, value, base, seed: F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("value"), F.lit(base).alias("base"), seed.alias("seed"))
    seeds = F.transform("_seeds", lambda x: item(x, F.substring(t, x["start"] + 1, x["end"] - x["start"]), True, F.lit(True)))
    out = out.withColumn("_found", F.array_sort(F.concat(seeds, F.transform(free, lambda x: item(x, x["value"], False, x["value"].rlike(SECRET))))))
    plain = F.translate(F.translate(t, ITEM, NEUTRAL), "123456789", "000000000")
    out = out.withColumn("_plain", plain if every else F.when(F.size("_found") > 0, plain))
    end_of = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("_found"), i - 1)["end"])
    between = F.transform("_found", lambda x, i: F.concat(F.substring(F.col("_plain"), end_of(i) + 1, x["start"] - end_of(i)), F.lit(ITEM)))
    rest = F.substring(F.col("_plain"), F.element_at(F.col("_found"), -1)["end"] + 1, F.length("_plain"))
    hidden = F.lower(F.when(F.size("_found") > 0, F.concat(F.array_join(between, ""), rest)).otherwise(F.col("_plain")))
    out = out.withColumn("_hidden", hidden)
    signs = F.transform(F.split("_hidden", WORD, -1), lambda x: F.translate(x, SILENT, ""))
    return out.withColumns({"_words": F.regexp_extract_all("_hidden", F.lit(WORD), F.lit(0)), "_signs": signs}).drop("_seeds", "_values", "_plain", "_hidden")


def _before(i: Column) -> Column:
    """The pattern that word i and the signs after it are for what comes next; null beside an item or the text's ends."""
    word = F.get(F.col("_words"), i)
    return F.when((i >= 0) & (word != ITEM), F.concat(F.lit("<"), word, F.get(F.col("_signs"), i + 1)))


def _after(i: Column) -> Column:
    word = F.get(F.col("_words"), i)
    return F.when(word != ITEM, F.concat(F.lit(">"), F.get(F.col("_signs"), i), word))


def with_items(df: DataFrame, text: str = "text") -> DataFrame:
    """df, which has _base, with _items: the place, value and patterns of each item, whether it is a base span and whether a seed."""
    out = with_words(df, text)
    at = F.filter(F.transform("_words", lambda w, i: F.when(w == ITEM, i)), lambda i: i.isNotNull())
    item = lambda x, i: x.withField("patterns", F.array_compact(F.array(_before(i - 1), _after(i + 1))))
    items = F.when(F.size("_found") > 0, F.zip_with("_found", at, item)).otherwise(F.zip_with(F.slice("_found", 1, 0), F.array().cast("array<int>"), item))
    return out.withColumn("_items", items).drop("_found", "_words", "_signs")


def elsewhere(texts: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """(pattern, other): how often each of the patterns is next to something that is no item, or to nothing."""
    out = with_words(with_base(texts.select(text), text), text, every=True)
    end = F.array(F.lit(None).cast("string"))
    shift = lambda c: F.slice(F.col(c), 2, F.size(c))
    every_word = F.arrays_zip(F.col("_words").alias("word"), F.col("_signs").alias("sign"), shift("_signs").alias("sign_after"), F.concat(end, "_words").alias("prior"), shift("_words").alias("next"))
    words = out.select(F.inline(every_word).alias("word", "sign", "sign_after", "prior", "next")).where(F.col("word") != ITEM)
    free = lambda c: F.coalesce(F.col(c) != ITEM, F.lit(True))
    left = F.when(free("next"), F.concat(F.lit("<"), "word", "sign_after"))
    right = F.when(free("prior"), F.concat(F.lit(">"), "sign", "word"))
    every = words.select(F.explode(F.array(left, right)).alias("pattern")).where("pattern IS NOT NULL")
    few = patterns.count() <= MAX_SHIPPED
    return every.join(F.broadcast(patterns) if few else patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("other"))


def learn(items: DataFrame, texts: DataFrame, text: str, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """The patterns that are trusted, from rows with the column _items and the texts that they are from."""
    places = items.select(F.inline("_items")).select("value", "seed", F.explode("patterns").alias("pattern"))
    edges = kit.cut(places.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)  # fewer values can't be the support
    other = elsewhere(texts, kit.cut(sizes.select("pattern")), text)
    sizes = sizes.join(other, "pattern", "left").select("pattern", (F.col("n") + F.coalesce("other", F.lit(0))).alias("places"), "n")
    sizes = kit.cut(sizes.where(F.col("n") >= confidence * F.col("places")))  # others stay below, whatever their values score
    edges = kit.cut(edges.join(sizes.select("pattern", "places"), "pattern").withColumn("score", F.col("seed")))
    known = -1
    for _ in range(rounds):
        sums = edges.groupBy("pattern").agg((F.sum("score") / F.max("places")).alias("trust"), F.count_if(F.col("score") >= confidence).alias("support"))
        trusted = kit.cut(sums.where((F.col("trust") >= confidence) & (F.col("support") >= support)).select("pattern", "trust"))
        before, known = known, trusted.count()
        if known in (0, before):
            break
        told = edges.join(trusted, "pattern", "left")
        # of the two most trusted patterns of a value, the one that isn't the pattern itself
        best = told.where("trust IS NOT NULL").groupBy("value").agg(F.max(F.struct("trust", "pattern")).alias("one"), F.slice(F.sort_array(F.collect_list("trust"), False), 2, 1).alias("two"))
        vouched = F.when(F.col("one.pattern") != F.col("pattern"), F.col("one.trust")).otherwise(F.get("two", F.lit(0)))
        edges = kit.cut(edges.join(best, "value", "left").select("pattern", "value", "seed", "places", F.greatest("seed", F.coalesce(vouched, F.lit(0.0))).alias("score")))
    return trusted.select("pattern")


def with_spans(df: DataFrame, trusted: DataFrame) -> DataFrame:
    """df, which has _base and _items, with _all: base and new spans, sorted."""
    known = [r[0] for r in trusted.limit(MAX_PATTERNS + 1).collect()]
    if len(known) <= MAX_PATTERNS:
        chosen = F.filter("_items", lambda x: ~x["base"] & F.exists(x["patterns"], lambda p: p.isin(known))) if known else F.filter("_items", lambda x: F.lit(False))
    else:
        df = kit.cut(df.withColumn("_row", F.monotonically_increasing_id()))
        asked = df.select("_row", F.explode(F.filter("_items", lambda x: ~x["base"])).alias("_x")).select("_row", "_x", F.explode("_x.patterns").alias("pattern"))
        hit = asked.join(trusted, "pattern", "left_semi").groupBy(F.col("_row").alias("_of")).agg(F.collect_set("_x").alias("_hit"))
        df = df.join(hit, df["_row"] == hit["_of"], "left").drop("_row", "_of")
        chosen = F.coalesce("_hit", F.slice("_items", 1, 0))
    new = F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("id")).alias("k"), x["end"].alias("end")))
    out = df.withColumn("_all", F.array_sort(F.concat("_base", new)))
    return out.drop("_hit") if "_hit" in out.columns else out


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, n_id, base_spans, spans) of every row of df."""
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    narrow = kit.cut(with_items(with_base(texts, "_text"), "_text").select("_key", "_base", "_items"))
    found = with_spans(narrow, learn(narrow, texts, "_text"))
    count = lambda k: F.size(F.filter("_all", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("_key").alias(key), *[count(k) for k in KINDS], written(F.col("_base")).alias("base_spans"), written(F.col("_all")).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span in text replaced by its kind in brackets; spans that overlap become one, of the first's kind."""
    texts = df.select(F.col(text).alias("_text"))
    # Rows without items are left out after the cut: a filter before it would repeat the whole expression of the items.
    narrow = kit.cut(with_items(with_base(texts, "_text"), "_text").select("_items")).where(F.size("_items") > 0)
    out = with_spans(with_items(with_base(df, text), text), learn(narrow, texts, "_text"))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), last["k"].alias("k"), F.greatest(last["end"], s["end"]).alias("end"))
        overlaps = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    merge_safe = F.aggregate("_all", F.array().cast(SPAN), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(merge(acc, s)))
    out = out.withColumn("_all", merge_safe)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda s, i: F.concat(F.substring(F.col(text), F.when(i == 0, 0).otherwise(F.get(F.col("_all"), i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("_all"), i - 1)["end"])), F.get(names, s["k"]))
    tail = F.expr(f"substring(`{text}`, element_at(_all, -1).end + 1)")
    changed = F.concat(F.array_join(F.transform("_all", piece), ""), tail)
    return out.withColumn(text, F.when(F.size("_all") > 0, changed).otherwise(F.col(text))).drop("_base", "_items", "_all")
