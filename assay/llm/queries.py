"""The ten operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, embeddings, kit, langid, lmscore, pii, shards, simhash, subword, tokencount, urlfilter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The URL list of the query, by rule: first word, second word and top level of a host, and numbered hosts.
FIRST = "ads adult bargain bets casino cheap click coupon dating fake free games loan lucky pills poker prize promo replica slots spam sweep vip warez win".split()
SECOND = "bets box cash club deals farm hub land mart offers pills site store track win x zone".split()
TOPS = "com net org info biz".split()
NUMBERED = 200_000
ARRIVALS = 4


def block_list(spark: SparkSession) -> DataFrame:
    word = lambda words, to: F.explode(F.array(*map(F.lit, words))).alias(to)
    named = spark.range(1).select(word(FIRST, "a")).select("a", word(SECOND, "b")).select("a", "b", word(TOPS, "t"))
    numbered = spark.range(NUMBERED).select(F.concat(F.lit("h"), "id", F.lit(".node.example.com")).alias("entry"))
    return named.select(F.concat("a", F.lit("-"), "b", F.lit(".example."), "t").alias("entry")).unionByName(numbered)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(kit.load(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.load(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(kit.load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(kit.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.load(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.score(docs, lmscore.chosen_keys(kit.load(spark, sf_dir, "labels"))).drop("text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.load(spark, sf_dir, "documents").select("doc_id", "text")
    out = subword.encode(docs, check=True)
    return out.select("doc_id", F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids")).cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_xxhash64"), "lossless")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, kit.load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_matches", "contaminated", decontaminate.written(F.col("matches")).alias("matches"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(kit.load(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches, written in one pass; the store is compacted and cleared of what was merged, and its rows are read back."""
    docs = kit.load(spark, sf_dir, "documents")
    store, landing = shards.ShardStore(spark, kit.new_folder(spark, "shards"), docs.schema), kit.new_folder(spark, "landing")
    batch = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(ARRIVALS))
    docs.withColumn("_batch", batch).write.partitionBy("_batch").option("maxRecordsPerFile", store.shard_rows()).parquet(landing)
    for folder in store.folders(landing):
        store.adopt(folder, docs.schema)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(kit.load(spark, sf_dir, "pages"), RULES, block_list(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_language_id, op3_token_counts, op4_pii, op5_lm_scoring, op6_sentencepiece, op7_decontamination, op8_simhash_near_dedup, op9_sharding, op10_url_filter, pipeline)}


def _op10_sql() -> str:
    case_rule, case_verdict = "", ""
    for v, h, p in sorted(RULES, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != "block")):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        case_rule += f" WHEN {fits} THEN '{h}{p}'"
        case_verdict += f" WHEN {fits} THEN '{v}'"
    words = lambda x: f"(SELECT unnest({x!r}))"
    lower = "translate(regexp_extract({}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, {lower.format('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    entries AS (SELECT x.a || '-' || y.b || '.example.' || z.t AS entry FROM {words(FIRST)} x(a), {words(SECOND)} y(b), {words(TOPS)} z(t)
        UNION ALL SELECT 'h' || n || '.node.example.com' FROM range({NUMBERED}) r(n)),
    names AS (SELECT DISTINCT host, path, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) || [host || path]) AS name FROM b WHERE host <> ''),
    hit AS (SELECT DISTINCT host, path FROM names JOIN entries ON name = entry),
    c AS (SELECT b.*, hit.host IS NOT NULL AS listed FROM b LEFT JOIN hit ON b.host = hit.host AND b.path = hit.path)
    SELECT page_id, host, path, CASE{case_rule} ELSE NULL END AS rule,
           coalesce(CASE{case_verdict} ELSE NULL END, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
    FROM c"""


#: Links need all pairs of a label, in double precision; components by the smallest id that can be reached.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.id"""

OP9_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

ORACLE_SQL = {"op1_embedding_near_dedup": OP1_SQL, "op9_sharding": OP9_SQL, "op10_url_filter": _op10_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
