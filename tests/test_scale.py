"""What failed or grew too fast over larger tables: results are held against those of small keys, brute force or SQL."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from assay.operators import gazetteer, grams, vote
from assay.plans import derived, evaluation, relational


def shifted(spark, sf_dir, folder, by):
    """The first 20 customers and their orders, whose keys are shifted by a multiple of every rule's period."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey < 20")
    orders.withColumn("o_orderkey", F.col("o_orderkey").cast("long") + by).write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey < 20").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


#: A multiple of 5, 6, 7, 11, 13, 40 and 50, so that shifted keys are heard alike.
PERIOD = 600_600


def test_bands_with_clips_numbered_in_millions(spark, sf_dir, tmp_path):
    small, large = (sorted(map(tuple, derived.exact_by_band(spark, shifted(spark, sf_dir, tmp_path / str(n), n * PERIOD)).collect())) for n in (0, 15))
    assert small == large and small


def test_records_of_keys_beyond_32_bits(spark, sf_dir, tmp_path):
    small, large = (sorted(map(tuple, derived.reconciled_names(spark, shifted(spark, sf_dir, tmp_path / str(n), n * PERIOD)).collect())) for n in (0, 5000))
    assert small == large and small


def test_a_vote_compares_equal_texts_once(monkeypatch):
    calls, table = [], vote._table
    monkeypatch.setattr(vote, "_table", lambda a, b: calls.append(1) or table(a, b))
    texts = ["abc", "abxc", "axc"] * 100
    assert vote.column_vote(texts, [1.0] * 300) == "abc" and len(calls) <= 10
    rng = random.Random(4)
    for _ in range(200):
        texts = ["".join(rng.choices("ab ", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 9))]
        weights = [rng.choice([0.0, 0.3, 1.0]) for _ in texts]
        assert vote.column_vote(texts, weights) == plain_vote(texts, weights)


def plain_vote(texts, weights):
    """The vote as told, with every row compared with every other."""
    pairs = [(t, w) for t, w in zip(texts, weights, strict=True) if t]
    if len(pairs) < 2:
        return pairs[0][0] if pairs else ""
    medoid = min((t for t, _ in pairs), key=lambda t: sum(vote._table(t, o)[-1][-1] for o, _ in pairs))
    at, between = [Counter() for _ in medoid], [Counter() for _ in range(len(medoid) + 1)]
    for text, weight in pairs:
        for votes, symbols in zip((at, between), vote._aligned(text, medoid), strict=True):
            for column, symbol in zip(votes, symbols, strict=True):
                column[symbol] += weight
    first = lambda c: c.most_common(1)[0][0]
    return "".join(first(b) + a for b, a in zip(between, [*map(first, at), ""], strict=True))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_grams_are_told_without_rows_of_their_own(spark, sf_dir):
    assert "Generate" not in plan_of(relational.occurrences_by_words(spark, sf_dir))
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "B", "c", ""], k=rng.randint(0, 12))) for _ in range(60)] + [None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    words = [[] if t is None else t.lower().split(" ") for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    asked = grams.hashed(df.where("k < 5"), "k", "t", 3)
    met = {}
    for shipped in (0, 1000):
        found = grams.hashed(df, "k", "t", 3, asked, shipped)
        met[shipped] = sorted(map(tuple, found.join(asked.withColumnRenamed("k", "o"), ["h", "g"]).groupBy("k", "o").count().collect()))
    shared = [(k, o, len(want[k] & want[o])) for k in range(len(texts)) for o in range(5) if want[k] & want[o]]
    assert met[0] == met[1000] == shared
    assert sorted(map(tuple, grams.hashed(df, "k", "t", 3).groupBy("k").count().collect())) == [(k, len(w)) for k, w in enumerate(want) if w]


def test_occurrences_of_few_names_need_no_shuffle(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab -", k=rng.randint(0, 14))) for _ in range(80)] + [None, ""]
    names = ["ab", "a", "ab a", "b-", " a", "aab", "-", "ba b", "bb"]
    df, listed = spark.createDataFrame(list(enumerate(texts)), "k long, t string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = []
    for k, t in enumerate(texts):
        i, letter = 0, lambda x: x in "ab"
        while t and i < len(t):
            edge = i == 0 or not letter(t[i - 1])
            hit = max((n for n in names if edge and t.startswith(n, i) and not (i + len(n) < len(t) and letter(t[i + len(n)]))), key=len, default="")
            want += [(k, hit, i, i + len(hit))] if hit else []
            i += len(hit) or 1
    few, many = (gazetteer.occurrences(df, listed, "k", "t", letter="ab", shipped=n) for n in (100, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted(want) and len(want) > 50
    assert "Exchange" not in plan_of(few)


def test_draws_are_made_within_the_row_of_a_case(spark):
    rows = [(c, str(i), c * 100 + i) for c, n in ((1, 1), (2, 5), (3, 30)) for i in range(n)]
    drawn = evaluation.samples(spark.createDataFrame(rows + rows[:3], "case_id long, clip_id string, seq long"), (1, 4, 8), 2, 7)
    want = []
    for i, (k, r) in enumerate((k, r) for k in (1, 4, 8) for r in range(2)):
        for c, n in ((1, 1), (2, 5), (3, 30)):
            order = sorted(map(str, range(n)), key=lambda x: (hashlib.sha1(f"{x}:7:{k}:{r}".encode()).hexdigest(), x))
            want += [(c * 6 + i, c, x, k) for x in order[:k] if n >= k for _ in range(1 + ((c, x) in {(1, "0"), (2, "0"), (2, "1")}))]
    assert sorted((r.case_id, r._case, r.clip_id, r.k) for r in drawn.collect()) == sorted(want)
    assert "Window" not in plan_of(drawn)
