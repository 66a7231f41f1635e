"""Relational queries over the driver's tables. Each is a DataFrame plan and the SQL that it is held against.

Scans prune to the columns used; every limit has a total order; counts are long and doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.operators import audit, clustering, grams, intervals, ranking
from assay.sources.tables import load

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rnd(x: Column | str, n: int = 4) -> Column:
    return F.round(x, n)


# joins


@query("""SELECT coalesce(c_mktsegment, 'ALL') AS segment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS n_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment)""")
def cases_with_totals(spark: SparkSession, d: str) -> DataFrame:
    """Left join with counts by group and a grand total. Orders are counted per customer before the join, so it is narrow."""
    orders = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = load(spark, d, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left")
    return joined.rollup("c_mktsegment").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("n_orders")).select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), "customers", "n_orders")


@query("""SELECT o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_children(spark, d):
    """Inner join that nests the child rows of each parent in a stable order."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    keys = load(spark, d, "orders").select("o_orderkey")
    return keys.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_lines", "total", F.array_join(F.transform("x", lambda s: s["l_linenumber"].cast("string")), ",").alias("lines"))


@query("""SELECT c_custkey, o_orderkey AS last_order, o_orderstatus AS status FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON c_custkey = o_custkey AND rn = 1""")
def latest_per_case(spark, d):
    """Latest row of each key, by a partial aggregate instead of a window over all rows."""
    last = load(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return load(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("x.o_orderkey").alias("last_order"), F.col("x.o_orderstatus").alias("status"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def done_cases(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").join(load(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def todo_cases(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").join(load(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_extendedprice > 99000) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 2))""")
def extra_names(spark, d):
    """Anti join, then semi join."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    s = s.join(load(spark, d, "lineitem").where("l_quantity > 49 AND l_extendedprice > 99000").select("l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")
    return s.join(load(spark, d, "nation").where("n_regionkey IN (0, 1, 2)").select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("""SELECT c_custkey, coalesce(a.n_name, b.n_name, 'none') AS found FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey + 20
LEFT JOIN nation b ON b.n_nationkey = c_nationkey""")
def lookup_with_fallback(spark, d):
    """Two lookups on different keys, the first that finds something wins."""
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(a, F.col("ka") == F.col("c_nationkey") + 20, "left").join(b, F.col("kb") == F.col("c_nationkey"), "left").select("c_custkey", F.coalesce("a", "b", F.lit("none")).alias("found"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT a.p_name AS name, b.p_name AS near, levenshtein(a.p_name, b.p_name) AS dist,
row_number() OVER (PARTITION BY a.p_name ORDER BY levenshtein(a.p_name, b.p_name), b.p_name) AS rank
FROM n a JOIN n b ON a.p_name[1] = b.p_name[1] AND a.p_name <> b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 12) SELECT name, near, dist, rank::BIGINT AS rank FROM x WHERE rank <= 3""")
def blocked_neighbours(spark, d):
    """Fuzzy join within blocks of the first letter: distinct names, a length bound before the distance, best three."""
    names = load(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return ranking.nearest(names, names.withColumnRenamed("name", "near"), "name", "near", F.levenshtein("name", "near"), F.substring("name", 1, 1), F.substring("near", 1, 1), most=12, k=3)


@query("""SELECT a.p_brand AS brand, round(avg(levenshtein(a.p_name, b.p_name)), 4) AS mean_distance FROM (SELECT DISTINCT p_brand, p_name FROM part) a
JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON a.p_brand = b.p_brand AND a.p_name < b.p_name GROUP BY a.p_brand""")
def mean_pair_distance(spark, d):
    """Self join i < j over distinct names of a brand; a large brand is dealt into pairs of tiles."""
    met = ranking.pairs(load(spark, d, "part").select("p_brand", "p_name").distinct(), "p_brand", "p_name")
    return met.groupBy(F.col("p_brand").alias("brand")).agg(rnd(F.avg(F.levenshtein("p_name", "other"))).alias("mean_distance"))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.45), r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT id AS vec_id, min(reach) AS cluster FROM r GROUP BY id""")
def single_link_clusters(spark, d):
    """Single-link clusters of vectors within a label (the case)."""
    e = load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return clustering.single_link(e, "label", "vec_id", "embedding", 0.45).select("vec_id", "cluster")


@query("""WITH b AS (SELECT p_partkey AS k, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS lo, sum(p_size) OVER (ORDER BY p_partkey) AS hi FROM part)
SELECT s_suppkey, k AS bucket FROM supplier JOIN b ON s_suppkey * 7 >= lo AND s_suppkey * 7 < hi""")
def range_lookup(spark, d):
    """Place of an index in cumulative bounds: the bounds are cut into cells, so the range join is an equi join."""
    sizes = load(spark, d, "part").select(F.col("p_partkey").alias("bucket"), F.col("p_size").cast("long").alias("n"))
    bounds = intervals.cumulative(sizes, "bucket", "n")
    points = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7).alias("at"))
    return intervals.range_join(points, bounds, "at", "lo", "hi", 512).select("s_suppkey", "bucket")


@query("""WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), g AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY user_id ORDER BY s) + 86400 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(s) AS begin_s, (max(s) + 86400)::BIGINT AS end_s, count(*) AS n FROM r GROUP BY user_id, run""")
def merged_intervals(spark, d):
    """Coalescing of touching intervals [s, s + 1 day]."""
    e = load(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("begin_s"))
    return intervals.coalesce_ranges(e.withColumn("end_s", F.col("begin_s") + 86400), "user_id", "begin_s", "end_s")


@query("""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w WHERE len(w) >= 8),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM b WHERE len(w) >= 8)
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id""")
def occurrences_by_words(spark, d):
    """Multi-pattern containment by an equi join on word n-grams; two hashes name an n-gram: 128 bits instead of its text."""
    passages = grams.hashed(load(spark, d, "benchmark"), "item_id", "text", 8)
    found = grams.hashed(load(spark, d, "documents"), "doc_id", "text", 8, among=passages)
    return found.join(passages, ["h", "g"]).groupBy("doc_id", "item_id").agg(F.countDistinct("h", "g").alias("shared"))


# aggregates


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value, max(event_id) AS last_id FROM events GROUP BY event_type""")
def counts_by_type(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), rnd(F.avg("value")).alias("mean_value"), F.max("event_id").alias("last_id"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def global_counts(spark, d):
    return load(spark, d, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query("""SELECT k, count(*) FILTER (n >= k) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), (VALUES (3), (5), (10)) t(k) GROUP BY k""")
def yield_thresholds(spark, d):
    """How many keys reach each threshold, from one pass over the counts."""
    n = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(*[F.count_if(F.col("n") >= k).alias(str(k)) for k in (3, 5, 10)]).select(F.explode(F.create_map(*[x for k in (3, 5, 10) for x in (F.lit(k), F.col(str(k)))])).alias("k", "users"))


@query("""SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS n_all FROM events GROUP BY user_id, event_type""")
def nested_counts(spark, d):
    """Counter within a counter: each key's counts by type beside its total, from one aggregate."""
    by = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return by.withColumn("n_all", F.sum("n").over(W.partitionBy("user_id")))


CONSENSUS_SQL = """WITH s AS (SELECT user_id, event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY user_id, event_type),
t AS (SELECT user_id, sum(v) AS total, sum(n) AS events FROM s GROUP BY user_id),
r AS (SELECT s.user_id, event_type, round(v / coalesce(nullif(total, 0), 1), 4) AS support, events, row_number() OVER (PARTITION BY s.user_id ORDER BY round(v / coalesce(nullif(total, 0), 1), 4) DESC, event_type) AS rn
FROM s JOIN t ON s.user_id = t.user_id),
w AS (SELECT a.user_id, a.event_type AS winner, a.support, round(a.support - coalesce(b.support, 0), 4) AS margin, a.events::BIGINT AS events FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1)
SELECT *, CASE WHEN 100 * (support + margin) >= 75 THEN 'high' WHEN 100 * (support + margin) >= 55 THEN 'medium' ELSE 'low' END AS band FROM w"""


@query(CONSENSUS_SQL)
def consensus_support(spark, d):
    """Flagship: weighted support of each candidate, winner, margin over the runner-up, and band."""
    s = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    ranked = ranking.winner(s, "user_id", "event_type", "v", "n")
    score = 100 * (F.col("support") + F.col("margin"))
    return ranked.select("user_id", F.col("candidate").alias("winner"), "support", "margin", F.col("items").alias("events"), ranking.band(score).alias("band"))


@query("""SELECT round(avg(m), 4) AS mean_of_means, round(avg(o::INT), 4) AS oracle, count(*) AS cases FROM (SELECT source, avg(quality) AS m, bool_or(quality = 1) AS o FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def mean_of_means(spark, d):
    j = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    by = j.groupBy("source").agg(F.avg("quality").alias("m"), F.bool_or(F.col("quality") == 1).alias("o"))
    return by.agg(rnd(F.avg("m")).alias("mean_of_means"), rnd(F.avg(F.col("o").cast("int"))).alias("oracle"), F.count("*").alias("cases"))


@query("""SELECT CASE WHEN n_chars >= 5000 THEN 'high' WHEN n_chars >= 1500 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(quality), 4) AS exact FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def accuracy_by_band(spark, d):
    j = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return j.groupBy(ranking.band(F.col("n_chars"), 5000, 1500).alias("band")).agg(F.count("*").alias("n"), rnd(F.avg("quality")).alias("exact"))


@query("""SELECT o_custkey, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def arg_max(spark, d):
    """Arg-max with the first of equals: the tie key is negated inside the ordering struct."""
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("x")).select("o_custkey", (-F.col("x.k")).alias("best"))


@query("""SELECT user_id, event_type AS mode, round(w, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 4) DESC, event_type) AS rn FROM (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY 1, 2)) WHERE rn = 1""")
def weighted_mode(spark, d):
    s = load(spark, d, "events").groupBy("user_id", "event_type").agg(rnd(F.sum("value")).alias("w"))
    return ranking.top_k(s, ["user_id"], [F.desc("w"), F.asc("event_type")], 1).select("user_id", F.col("event_type").alias("mode"), F.col("w").alias("weight"))


@query("""SELECT event_type, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.1), 4) AS p10,
round(CASE WHEN quantile_cont(value, 0.1) > 0 AND quantile_cont(value, 0.9) > 0 THEN 10 * log10(quantile_cont(value, 0.9) / quantile_cont(value, 0.1)) END, 4) AS ratio_db FROM events GROUP BY event_type""")
def percentile_ratio(spark, d):
    """Linear-interpolated percentiles and their ratio in decibels; only the cells that hold the ranks are sorted."""
    x = ranking.percentiles(load(spark, d, "events"), "event_type", "value", [0.9, 0.1])
    db = F.when((F.col("p1") > 0) & (F.col("p0") > 0), 10 * F.log10(F.col("p0") / F.col("p1")))
    return x.select("event_type", rnd("p0").alias("p90"), rnd("p1").alias("p10"), rnd(db).alias("ratio_db"))


@query("SELECT md5(text) AS text_key, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text")
def first_seen(spark, d):
    """First-seen-wins by a digest of the text, so the shuffle carries 32 bytes instead of the text."""
    return load(spark, d, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT round(avg(n), 4) AS clips_per_case, round(avg(u), 4) AS speakers_per_case FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY event_type)")
def per_case_means(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u")).agg(rnd(F.avg("n")).alias("clips_per_case"), rnd(F.avg("u")).alias("speakers_per_case"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_values(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


# windows, order, sets


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, event_id) AS place FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3) WHERE place <= 5""")
def diverse_selection(spark, d):
    """Round-robin over types: the first of each type, then the seconds, then the thirds, five per user."""
    return ranking.pick_diverse(load(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_type", [F.desc("value"), F.asc("event_id")], ["event_id"], rounds=3, k=5).select("event_id", "user_id")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def collapsed_runs(spark, d):
    """Only the first of consecutive equal values."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "ts").withColumn("before", before).where("before IS NULL OR before <> event_type").select("event_id", "user_id", "event_type")


@query("""SELECT event_id, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbour_tokens(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("prev"), F.lead("event_type").over(w).alias("next"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def newest_first(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate ASC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 4""")
def capped_per_key(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return ranking.top_k(o, ["o_orderpriority"], [F.asc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")], 4).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1(c_custkey || ':42'), c_custkey) AS rn FROM customer) WHERE rn <= 7""")
def seeded_sample(spark, d):
    """Seeded sample without replacement of seven per group, by a hash order."""
    c = load(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return ranking.sample_k(c, "c_mktsegment", "c_custkey", 42, 7).select("c_mktsegment", "c_custkey")


@query("""SELECT key, sum(a)::BIGINT AS in_a, sum(b)::BIGINT AS in_b FROM (SELECT DISTINCT o_custkey AS key, 1 AS a, 0 AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey, 0, 1 FROM orders WHERE o_orderstatus = 'O') GROUP BY key""")
def key_sets(spark, d):
    """Membership of keys in two sets: union, intersection and differences in one pass."""
    o = load(spark, d, "orders").where("o_orderstatus IN ('F', 'O')")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.max((F.col("o_orderstatus") == "F").cast("long")).alias("in_a"), F.max((F.col("o_orderstatus") == "O").cast("long")).alias("in_b"))


@query("(SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R') INTERSECT (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def key_intersection(spark, d):
    return load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(load(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("(SELECT s_suppkey AS k FROM supplier) EXCEPT (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_extendedprice > 99000)")
def key_difference(spark, d):
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).subtract(load(spark, d, "lineitem").where("l_quantity > 49 AND l_extendedprice > 99000").select("l_suppkey"))


@query("""SELECT k, max_by(v, p) AS v FROM (SELECT n_nationkey AS k, n_name AS v, 1 AS p FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region) GROUP BY k""")
def last_source_wins(spark, d):
    """Keyed overwrite of one source by a later one."""
    a = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.lit(1).alias("p"))
    return a.unionByName(load(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"), F.lit(2).alias("p"))).groupBy("k").agg(F.max_by("v", "p").alias("v"))


# scalars, filters


@query("""SELECT page_id, substr(sha1(page_id || '|' || url), 1, 12) AS clip_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '[^/]*$') AS tail FROM pages""")
def page_ids(spark, d):
    return load(spark, d, "pages").select("page_id", F.substring(F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), "url")), 1, 12).alias("clip_id"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.substring_index("url", "/", -1).alias("tail"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, round(value / nullif(props->>'$.k', '0')::DOUBLE, 9) AS ratio FROM events")
def json_fields(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").select("event_id", k.alias("k"), rnd(F.try_divide(F.col("value"), k.cast("double")), 9).alias("ratio"))


@query("""SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'), ' ') = text AS was_clean, length(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'), ' '))::BIGINT AS n FROM documents""")
def collapsed_spaces(spark, d):
    t = F.trim(F.regexp_replace("text", "[ \t\n]+", " "))
    return load(spark, d, "documents").select("doc_id", (t == F.col("text")).alias("was_clean"), F.length(t).cast("long").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00001') OR contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'x9')""")
def search_or(spark, d):
    from assay.functions import text

    return load(spark, d, "customer").where(text.matches_any("00001", ["c_name"], []) | text.matches_any("build", [], ["c_mktsegment"]) | text.matches_any("x9", [], ["c_name"])).select("c_custkey", "c_name")


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM part""")
def capitalised(spark, d):
    from assay.functions import text

    return load(spark, d, "part").select("p_partkey", text.capitalise_words(F.col("p_name")).alias("title"))


@query("""SELECT p_partkey, round(levenshtein(replace(p_name, ' ', ''), replace(p_type, ' ', '')) / greatest(1, length(replace(p_type, ' ', ''))), 4) AS cer FROM part""")
def error_rate(spark, d):
    from assay.functions import text

    return load(spark, d, "part").select("p_partkey", rnd(text.error_rate(F.col("p_name"), F.col("p_type"))).alias("cer"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 0 OR o_orderpriority = '' THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'on hold' END AS status FROM orders""")
def decision_status(spark, d):
    bad = (F.col("o_totalprice") < 0) | (F.col("o_orderpriority") == "")
    return load(spark, d, "orders").select("o_orderkey", F.when(bad, "rejected").when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("on hold").alias("status"))


AUDIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, 'genesis' AS prev_hash, sha256('genesis' || '|' || event_id || '|' || event_type) AS hash FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, c.hash, sha256(c.hash || '|' || e.event_id || '|' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, event_id, prev_hash, hash FROM c"""


def _chained(spark, d):
    return audit.chain(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"])


@query(AUDIT_SQL)
def audit_links(spark, d):
    """A hash chain for every user: each entry is hashed with the hash of the one before."""
    return _chained(spark, d).select("user_id", "event_id", "prev_hash", "hash")


@query("""SELECT user_id, min(event_id) FILTER (event_id % 97 = 0) IS NULL AS ok, min(event_id) FILTER (event_id % 97 = 0) AS first_bad FROM events GROUP BY user_id""")
def audit_verified(spark, d):
    """Verification of all chains, after every 97th entry was changed behind the log's back."""
    changed = F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    return audit.verify_logs(_chained(spark, d).withColumn("event_type", changed), "user_id", "event_id", ["event_id", "event_type"])
