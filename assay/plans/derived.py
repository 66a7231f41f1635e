"""Names, evidence, hits and reviews derived from the driver's tables, and the queries of the domain operators over them.

A number is spelled as a name, a syllable for each digit; orders are the clips of their customer's name, some of them misheard.
So every query reads whole tables, and SQL spells the names by the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import devanagari as dv
from assay.operators import clustering, gates, gazetteer, planning, ranking
from assay.operators import reconcile as rc
from assay.operators.vote import voted
from assay.plans import evaluation, reports, review
from assay.sources.tables import load

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Syllable of each digit, and its phones and Roman letters.
SYLLABLES = ["का", "ची", "टू", "ते", "नो", "पा", "मी", "रू", "ले", "सो"]
PHONES = ["kaː", "t͡ʃiː", "ʈuː", "t̪eː", "noː", "paː", "miː", "ruː", "leː", "soː"]
ROMAN = ["ka", "chi", "tu", "te", "no", "pa", "mi", "ru", "le", "so"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spelled(number: Column) -> Column:
    out = number.cast("string")
    for digit, syllable in enumerate(SYLLABLES):
        out = F.replace(out, F.lit(str(digit)), F.lit(syllable))
    return out


def spelled_sql(number: str, by: list[str] = SYLLABLES) -> str:
    out = f"({number})::VARCHAR"
    for digit, syllable in enumerate(by):
        out = f"replace({out}, '{digit}', '{syllable}')"
    return out


def rnd(x: Column | str, n: int = 4) -> Column:
    return F.round(x, n)


# evidence: an order is a clip of its customer's name; every fifth loses its last syllable, every seventh has another vowel

HEARD_SQL = f"""CASE WHEN o_orderkey % 5 = 0 AND length(n) > 2 THEN substr(n, 1, length(n) - 2) WHEN o_orderkey % 7 = 0 THEN replace(n, 'ा', 'ि') ELSE n END"""
CLIPS_SQL = f"""WITH o AS (SELECT *, {spelled_sql("o_custkey")} AS n FROM orders),
w AS (SELECT o_custkey AS case_id, o_orderkey AS clip_id, n AS truth, {HEARD_SQL} AS heard, (o_orderkey % 6)::VARCHAR AS speaker, o_orderkey % 11 = 0 AS synthetic,
      o_orderkey % 40 AS snr_db, 0.5 + (o_orderkey % 50) / 100.0::DOUBLE AS conf FROM o WHERE o_orderkey % 13 <> 0),
c AS (SELECT *, conf * (0.5 + 0.5 * least(1.0, greatest(0.0, (snr_db - 5) / 20.0::DOUBLE))) * CASE WHEN synthetic THEN 0.4 ELSE 1.0 END AS weight FROM w)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    o, n = load(spark, d, "orders").select("o_custkey", "o_orderkey"), spelled(F.col("o_custkey"))
    k = F.col("o_orderkey")
    heard = F.when((k % 5 == 0) & (F.length(n) > 2), F.substring(n, F.lit(1), F.length(n) - 2)).when(k % 7 == 0, F.replace(n, F.lit("ा"), F.lit("ि"))).otherwise(n)
    return o.select(
        F.col("o_custkey").cast("long").alias("case_id"), k.cast("string").alias("clip_id"), k.cast("long").alias("seq"), F.lit(0).alias("wseq"), (k % 6).cast("string").alias("speaker"), (k % 11 == 0).alias("synthetic"),
        (k % 40).cast("double").alias("snr_db"), F.when(k % 13 == 0, "phones").otherwise("vakyansh").alias("witness"), heard.alias("text"), (0.5 + (k % 50) / 100).alias("conf"),
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("case_id"), spelled(F.col("c_custkey")).alias("name"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's name reconciled; every second one has a record of it."""
    known = truth(spark, d).where("case_id % 2 = 0").select("case_id", F.col("name").alias("hi"), F.lit("").alias("en"))
    return rc.reconcile(evidence(spark, d), known)


@query(f"""SELECT c_custkey AS id, {spelled_sql("c_custkey")} AS name, '/' || {spelled_sql("c_custkey", PHONES)} || '/' AS ipa,
upper(substr({spelled_sql("c_custkey", ROMAN)}, 1, 1)) || substr({spelled_sql("c_custkey", ROMAN)}, 2) AS roman FROM customer""")
def sounded_names(spark, d):
    """Normal form, phones and Roman letters of every name, each distinct one sounded once."""
    names = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), dv.normalise(F.concat(F.lit(" "), spelled(F.col("c_custkey")), F.lit("‍ "))).alias("name"))
    return names.join(rc.sounded(names, "name"), "name").select("id", "name", "ipa", F.col("scheme").alias("roman"))


@query(CLIPS_SQL + " SELECT case_id, clip_id::VARCHAR AS clip_id, round(weight, 6) AS weight, heard AS best FROM c WHERE heard <> ''")
def clip_weights(spark, d):
    """Evidence weight of every clip."""
    hyps = evidence(spark, d).where(F.col("witness").isin(*rc.WITNESS_WEIGHTS)).withColumn("norm", dv.normalise(F.col("text")))
    return rc.clip_weights(hyps).select("case_id", "clip_id", rnd("weight", 6).alias("weight"), "best")


@query(CLIPS_SQL + """, p AS (SELECT case_id, avg((heard = truth)::INT) AS a, max((heard = truth)::INT) AS o, arg_max((heard = truth)::INT, {'w': weight, 's': -clip_id}) AS c, count(*) AS n, count(DISTINCT speaker) AS s FROM c WHERE heard <> '' GROUP BY case_id)
SELECT count(*) AS cases, round(avg(n), 4) AS clips_per_case, round(avg(s), 4) AS speakers_per_case, round(avg(a), 4) AS random, round(avg(c), 4) AS clearest, round(avg(o), 4) AS oracle FROM p""")
def single_clip_rates(spark, d):
    out = evaluation.single_clips(evidence(spark, d), truth(spark, d))
    return out.select("cases", *[rnd(c).alias(c) for c in ("clips_per_case", "speakers_per_case", "random", "clearest", "oracle")])


@query()
def reconciled_names(spark, d):
    """The record of every case. SQL has no phone distances; tests hold the names against the truth."""
    return records(spark, d).selectExpr("case_id", "devanagari", "ipa", "roman.recommended AS roman", "confidence.score AS score", "confidence.band AS band", "size(candidates) AS n_candidates", "size(variants) AS n_variants", "array_join(flags, '; ') AS flags", "error")


@query()
def exact_by_band(spark, d):
    return evaluation.by_band(records(spark, d), truth(spark, d)).select("band", "n", rnd("exact").alias("exact"))


@query(f"""WITH o AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS clip, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
d AS (SELECT o.*, k, r, row_number() OVER (PARTITION BY c, k, r ORDER BY sha1(clip || ':0:' || k || ':' || r), clip::VARCHAR) AS rank FROM o, (SELECT unnest([1, 2, 3, 4, 6, 8])) t(k), range(3) s(r) WHERE n >= k)
SELECT c AS case_id, k, count(*) AS clips, sum(clip)::BIGINT AS key_sum FROM d WHERE rank <= k GROUP BY c, k""")
def clip_samples(spark, d):
    """The draws of the evaluation's sweep: k clips of each case that has so many, three times for every k."""
    drawn = evaluation.samples(evidence(spark, d))
    return drawn.groupBy(F.col("_case").alias("case_id"), "k").agg(F.count("*").alias("clips"), F.sum(F.col("clip_id").cast("long")).alias("key_sum"))


@query()
def voted_names(spark, d):
    """Column vote over the clips of every case. SQL has no alignment; tests hold the vote against brute force."""
    clips = rc.clip_weights(evidence(spark, d).where("witness = 'vakyansh'").withColumn("norm", dv.normalise(F.col("text"))))
    listed = clips.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seq", "best", "weight"))).alias("x"))
    return listed.select("case_id", voted(F.col("x.best"), F.col("x.weight")).alias("voted"))


# gazetteer, occurrences, plans


@query(f"""WITH s AS (SELECT 0 AS p, 'district' AS src, {spelled_sql("s_suppkey")} AS name, 'S' || s_suppkey AS en, s_suppkey::VARCHAR AS item FROM supplier
UNION ALL SELECT 1, 'town', {spelled_sql("c_custkey")}, 'C' || c_custkey, c_custkey::VARCHAR FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, en, item) AS rn FROM s WHERE length(name) >= 3)
SELECT r.name, en, item, src, EXISTS (SELECT 1 FROM nation WHERE {spelled_sql("n_nationkey")} = r.name) AS ambiguous FROM r WHERE rn = 1""")
def gazetteer_names(spark, d):
    """Priority union of two sources with administrative words to take off; names that are common words are marked."""
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    districts = s.select(F.concat(spelled(F.col("s_suppkey")), F.lit(" जिला")).alias("hi"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(" District")).alias("en"), F.concat(F.lit("x/"), F.col("s_suppkey").cast("string")).alias("item"))
    towns = c.select(F.concat(spelled(F.col("c_custkey")), F.lit(", भारत")).alias("hi"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("en"), F.col("c_custkey").cast("string").alias("item"))
    common = load(spark, d, "nation").select(spelled(F.col("n_nationkey")).alias("word"))
    return gazetteer.build([("district", districts), ("town", towns)], common)


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents) SELECT doc_id, name, count(*) AS n FROM w JOIN n USING (name) GROUP BY doc_id, name""")
def name_occurrences(spark, d):
    """Occurrences of several hundred names in whole texts, not within a run of letters."""
    names = load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("name")).distinct()
    found = gazetteer.occurrences(load(spark, d, "documents").select("doc_id", "text"), names, "doc_id", letter="A-Za-z")
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query()
def fetch_plan(spark, d):
    """Which occurrences to fetch for every type of part: parts are hits, suppliers' regions the row groups. Tests hold the fold against brute force."""
    hits = load(spark, d, "part").select(
        F.when(F.col("p_size") % 2 == 0, "indicvoices").otherwise("shrutilipi").alias("corpus"), F.col("p_brand").alias("path"), (F.col("p_partkey") % 10).cast("int").alias("rg"),
        F.col("p_partkey").cast("int").alias("row"), F.col("p_type").alias("name"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("").alias("text"), (F.col("p_retailprice") % 20).alias("duration"),
    )
    return planning.plan(planning.usable(hits, hits.select("name")), per_name=8, max_groups=60)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4), r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS cluster FROM r GROUP BY id),
n AS (SELECT vec_id, label, cluster, row_number() OVER (PARTITION BY label, cluster ORDER BY vec_id) AS rn FROM embeddings JOIN c ON vec_id = id)
SELECT label, label || '-x' || cluster AS speaker, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rn, vec_id) AS place FROM n WHERE rn <= 3) WHERE place <= 8""")
def diverse_by_voice(spark, d):
    """Speakers are clusters of voices within a case, keyed by both; then up to eight clips of a case, a speaker at a time."""
    voices = clustering.single_link(load(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", 0.4)
    keyed = voices.withColumn("speaker", F.concat_ws("-x", F.col("label").cast("string"), F.col("cluster").cast("string")))
    return ranking.pick_diverse(keyed, "label", "speaker", [F.asc("vec_id")], ["vec_id"], rounds=3, k=8).select("label", "speaker", "vec_id")


# gates and reports

CUTS_SQL = "SELECT event_id, event_type, CASE WHEN event_id % 17 <> 0 THEN value / 500 END AS distance, CASE WHEN event_id % 17 <> 0 THEN (value % 70) / 100 END AS error, event_id * 37 % 4000 AS samples FROM events"


def cuts(spark: SparkSession, d: str) -> DataFrame:
    e, cut = load(spark, d, "events"), F.col("event_id") % 17 != 0
    return e.select("event_id", "event_type", F.when(cut, F.col("value") / 500).alias("distance"), F.when(cut, (F.col("value") % 70) / 100).alias("error"), (F.col("event_id") * 37 % 4000).alias("samples"))


@query(f"SELECT event_id FROM ({CUTS_SQL}) WHERE samples >= 1600 AND distance <= 0.34")
def kept_clips(spark, d):
    return cuts(spark, d).where(gates.clip_passes(F.col("samples"), F.col("distance"))).select("event_id")


@query(f"SELECT event_id, CASE WHEN distance <= 0.5 THEN event_type || '!' ELSE event_type END AS text, CASE WHEN distance <= 0.5 THEN 'sentence' ELSE 'clip' END AS context FROM ({CUTS_SQL})")
def accepted_in_context(spark, d):
    x = gates.accepted(F.concat("event_type", F.lit("!")), F.col("event_type"), F.col("distance"))
    return cuts(spark, d).withColumn("x", x).select("event_id", "x.text", "x.context")


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (distance <= 0.34) AS located, count(*) FILTER (coalesce(error, 1) <= 0.25) AS pass_25, count(*) FILTER (coalesce(error, 1) <= 0.34) AS pass_34, round(avg(coalesce(error, 1)), 4) AS mean_error
FROM ({CUTS_SQL}) GROUP BY event_type""")
def cut_pass_rates(spark, d):
    return gates.pass_rates(cuts(spark, d), ["event_type"], "error", "distance").withColumn("mean_error", rnd("mean_error"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora: lines and orders heard of parts and customers under short names."""
    lines = load(spark, d, "lineitem").select(F.concat(F.lit("name"), (F.col("l_partkey") % 97).cast("string")).alias("name"), F.col("l_suppkey").cast("string").alias("speaker"))
    orders = load(spark, d, "orders").select(F.concat(F.lit("name"), (F.col("o_custkey") % 211).cast("string")).alias("name"))
    return reports.corpora([("lines", lines), ("orders", orders)])


HITS_SQL = "SELECT 'name' || (l_partkey % 97) AS name, l_suppkey::VARCHAR AS speaker, 'lines' AS corpus FROM lineitem UNION ALL SELECT 'name' || (o_custkey % 211), NULL, 'orders' FROM orders"


@query(f"SELECT name, corpus, count(*) AS n, count(DISTINCT speaker) AS speakers FROM ({HITS_SQL}) GROUP BY name, corpus")
def occurrences_by_corpus(spark, d):
    return reports.by_corpus(hits(spark, d))


@query(f"""WITH h AS ({HITS_SQL}), t AS (SELECT name, count(*) AS n, count(DISTINCT speaker) AS speakers, substr(name, 5)::INT % 3 = 0 AS ambiguous FROM h GROUP BY name), c AS (SELECT * FROM t WHERE NOT ambiguous AND length(name) >= 6)
SELECT 'names' AS what, count(*) AS n FROM t UNION ALL SELECT 'unambiguous', count(*) FROM c UNION ALL SELECT 'at least 3', count(*) FROM c WHERE n >= 3 UNION ALL SELECT 'at least 5', count(*) FROM c WHERE n >= 5
UNION ALL SELECT 'at least 10', count(*) FROM c WHERE n >= 10 UNION ALL SELECT 'speakers at least 3', count(*) FROM c WHERE speakers >= 3""")
def yield_report(spark, d):
    h = hits(spark, d)
    names = h.select("name").distinct().withColumn("ambiguous", F.substring("name", F.lit(5), F.length("name")).cast("int") % 3 == 0)
    return reports.yields(h, names, 6)


@query(f"SELECT name, count(*) AS n FROM ({HITS_SQL}) GROUP BY name ORDER BY n DESC, name LIMIT 40")
def top_names(spark, d):
    return reports.top_names(hits(spark, d), 40)


@query("""WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
n AS (SELECT "column", value, count(*) AS n FROM c GROUP BY ALL) SELECT "column", value, n FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5""")
def probed_columns(spark, d):
    return reports.probe(load(spark, d, "part"), ["p_brand", "p_type", "p_size"], 5)


@query("""WITH h AS (SELECT p_type AS word, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 7 = 0 THEN p_name ELSE p_type END AS text FROM part),
j AS (SELECT word, levenshtein(replace(text, ' ', ''), replace(word, ' ', '')) / greatest(1, length(replace(word, ' ', '')))::DOUBLE AS e, (lower(replace(text, ' ', '')) = lower(replace(word, ' ', '')))::INT AS r FROM h),
p AS (SELECT word, sum(e) AS e, sum(r) AS r, count(*) AS n, min(e) AS best FROM j GROUP BY word)
SELECT round(sum(e) / sum(n), 6) AS clip_error, round(sum(r) / sum(n), 6) AS clip_exact, round(avg(best), 6) AS best_clip_error FROM p""")
def recogniser_errors(spark, d):
    """Mean error and share of exact clips, and the best clip of a word: the vote's own columns have tests."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    out = reports.errors(load(spark, d, "part").select(F.col("p_type").alias("word"), F.col("p_partkey").alias("seq"), text.alias("text")))
    return out.select(*[rnd(c, 6).alias(c) for c in ("clip_error", "clip_exact", "best_clip_error")])


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || ',"type":"' || event_type || '","big":' || CASE WHEN value > 100 THEN 'true' ELSE 'false' END || '}' AS encoded FROM events""")
def encoded_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"), (F.col("value") > 100).alias("big"))).alias("encoded"))


# review: customers are cases, orders their clips, and the orders' statuses decisions

STATUS_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'on hold' END"
DECISIONS_SQL = """SELECT o_orderkey AS id, o_custkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'hold' WHEN 3 THEN 'approve' ELSE 'delete' END AS action,
CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'officer' || (o_orderkey % 4) END AS officer, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'because' END AS reason FROM orders"""
JUDGED_SQL = f"""SELECT *, CASE WHEN action = 'delete' THEN 'unknown action' WHEN trim(officer) = '' THEN 'an officer is required' WHEN action <> 'approve' AND reason = '' THEN 'a reason is required' END AS refused FROM ({DECISIONS_SQL})"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected", "on hold"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name_hi"), F.col("c_mktsegment").alias("kind"), F.lower("c_mktsegment").alias("existing_en"), status.alias("status"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("speaker"), F.concat(F.lit("clips/"), "o_orderkey", F.lit(".wav")).alias("file"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("approve", "reject", "hold", "approve", "delete"))), (k % 5 + 1).cast("int"))
    officer = F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("officer"), (k % 4).cast("string")))
    given = [F.lit("").alias(c) for c in ("devanagari", "roman", "ipa", "notes")]
    return load(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").cast("long").alias("case_id"), action.alias("action"), officer.alias("officer"), F.when(k % 3 == 0, "").otherwise("because").alias("reason"), F.col("o_totalprice").alias("ts"), *given)


def shown_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as far as the queue and decisions show them, from the totals of customers' orders."""
    score = rnd(F.max("o_totalprice") / 5000, 1)
    by = load(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("case_id")).agg(score.alias("score"), F.count("*").alias("clips"), F.countDistinct("o_orderpriority").alias("speakers"))
    confidence = F.struct("score", ranking.band(F.col("score"), 95, 85).alias("band"), "clips", "speakers")
    name = spelled(F.col("case_id"))
    return by.select("case_id", name.alias("devanagari"), F.struct(F.concat(F.lit("R"), F.col("case_id").cast("string")).alias("recommended")).alias("roman"), F.lit("/x/").alias("ipa"), confidence.alias("confidence"), F.array(F.lit("f")).alias("flags"), F.array(F.lit(1)).alias("variants"))


@query(f"""SELECT {STATUS_SQL} AS what, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'cases', count(*) FROM customer UNION ALL SELECT 'clips', count(*) FROM orders UNION ALL SELECT 'speakers', count(DISTINCT o_orderpriority) FROM orders""")
def review_totals(spark, d):
    return review.totals(cases(spark, d), clips(spark, d))


@query(f"""WITH r AS (SELECT o_custkey, round(max(o_totalprice) / 5000, 1) AS confidence, count(*) AS clips, count(DISTINCT o_orderpriority) AS speakers FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, c_name AS name_hi, confidence, clips, speakers FROM customer JOIN r ON c_custkey = o_custkey WHERE {STATUS_SQL} = 'pending' AND confidence >= 85 AND confidence < 95 AND (contains(c_name, '1') OR contains(lower(c_mktsegment), '1') OR contains(lower('R' || c_custkey), '1'))""")
def review_queue(spark, d):
    return review.queue(cases(spark, d), shown_records(spark, d), "pending", "1", "medium").select("id", "name_hi", "confidence", "clips", "speakers")


@query(f"""WITH r AS (SELECT o_custkey, round(max(o_totalprice) / 5000, 1) AS confidence FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(confidence, 0) AS confidence, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, c_name, c_custkey) AS place FROM customer LEFT JOIN r ON c_custkey = o_custkey AND c_custkey % 9 <> 0 ORDER BY place LIMIT 500""")
def queue_by_confidence(spark, d):
    """The queue from the surest case down, those without a record as 0, up to five hundred."""
    told = review.queue(cases(spark, d), shown_records(spark, d).where("case_id % 9 <> 0"))
    return review.by_confidence(told, "desc", 500)


@query(f"SELECT coalesce(refused, 'accepted') AS refused, count(*) AS n FROM ({JUDGED_SQL}) GROUP BY 1")
def refused_decisions(spark, d):
    return review.refusals(decisions(spark, d)).groupBy(F.coalesce("refused", F.lit("accepted")).alias("refused")).agg(F.count("*").alias("n"))


@query(f"""WITH j AS (SELECT * FROM ({JUDGED_SQL}) WHERE refused IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id DESC) AS rn FROM j)
SELECT c_custkey AS id, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'hold' THEN 'on hold' ELSE {STATUS_SQL} END AS status, coalesce({spelled_sql("r.case_id")}, '') AS devanagari
FROM customer LEFT JOIN r ON c_custkey = case_id AND rn = 1""")
def decided_cases(spark, d):
    """Every case under its last accepted decision, with the spelling that was decided on."""
    decided = review.decide(decisions(spark, d), shown_records(spark, d))
    last = decided.groupBy(F.col("case_id").alias("id")).agg(F.max_by("devanagari", "id").alias("devanagari"))
    return review.with_status(cases(spark, d), decided).join(last, "id", "left").select("id", "status", F.coalesce("devanagari", F.lit("")).alias("devanagari"))


@query(f"""WITH j AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id DESC) AS rn FROM ({JUDGED_SQL}) WHERE refused IS NULL), a AS (SELECT case_id, max(id) AS last FROM ({JUDGED_SQL}) WHERE refused IS NULL AND action = 'approve' GROUP BY case_id)
SELECT c_name AS name_hi, {spelled_sql("c_custkey")} AS devanagari, 'R' || c_custkey AS roman, officer, coalesce(sha256(last::VARCHAR), '') AS audit_hash FROM customer JOIN j ON c_custkey = j.case_id AND rn = 1 LEFT JOIN a ON a.case_id = c_custkey WHERE action = 'approve'""")
def approved_export(spark, d):
    """The export: approved cases with the hash of their last approval."""
    decided = review.decide(decisions(spark, d), shown_records(spark, d))
    stored = decided.withColumn("record", F.struct("devanagari", "roman", "ipa"))
    entries = decided.select("id", "case_id", "action", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    return review.approved(review.with_status(cases(spark, d), decided), stored, entries).select("name_hi", "devanagari", "roman", "officer", "audit_hash")


@query("SELECT o_orderkey::VARCHAR AS id, 'clips/' || o_orderkey || '.wav' AS file FROM orders WHERE o_orderkey % 10 = 0")
def clip_files(spark, d):
    """Clips to decode again, with their files."""
    asked = load(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return review.files_of(asked, clips(spark, d))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^a-z ]', '', 'g'), '[a-z]', '', 'g') || " + spelled_sql("p_partkey") + " AS kept FROM part")
def letters_kept(spark, d):
    """Only Devanagari letters and spaces of mixed texts."""
    mixed = F.concat("p_name", spelled(F.col("p_partkey")), F.lit("-x!"))
    return load(spark, d, "part").select("p_partkey", dv.letters_only(mixed).alias("kept"))
