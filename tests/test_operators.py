"""Relational operators on small tables, every driver query at the smallest size, and the entry point without the corpus parts."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.operators import audit, clustering, intervals, ranking
from assay.plans import registry
from assay.sources import tables

ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in ALL:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df, want = registry.QUERIES[name](spark, sf_dir), db.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_audit_chain(spark):
    log = spark.createDataFrame([], tables.SCHEMAS["audit"])
    log = audit.append(log, [{"ts_micros": 1, "actor": "system", "action": "built", "case_id": 1, "detail": None}, {"ts_micros": 2, "actor": "a|b", "action": "approve", "case_id": 1, "detail": "x"}])
    log = audit.append(log, [{"ts_micros": 3, "actor": "c", "action": "reject", "case_id": None, "detail": ""}])
    assert [tuple(audit.verify(log, cell).first()) for cell in (1 << 20, 1, 2)] == [(True, None)] * 3
    bad = log.withColumn("action", F.when(F.col("id") == 2, "reject").otherwise(F.col("action")))
    assert tuple(audit.verify(bad).first()) == (False, 2) and tuple(audit.verify(log.where("id <> 2"), 2).first()) == (False, 3)


def test_sinks_upsert_and_resume(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.replace_by_key(old, new, "id", old).collect())) == [(2, "c"), (3, "d")]
    tables.write_jsonl(old, f"{tmp_path}/j")
    assert [r.id for r in tables.resume(spark, new, tables.read_jsonl(spark, f"{tmp_path}/j", "id int, v string"), "id").collect()] == [3]
    tables.write_csv(new, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", "id int, v string").collect())) == [(2, "c"), (3, "d")]
    (tmp_path / "a.yaml").write_text("- {hi: x, en: one, kind: k}\n- {hi: y, en: two, kind: k}\n")
    (tmp_path / "b.yaml").write_text("- {hi: x, en: three, kind: k}\n")
    got = tables.read_mapping(spark, [f"{tmp_path}/a.yaml", f"{tmp_path}/b.yaml"], "hi", tables.SCHEMAS["targets"])
    assert sorted(r.en for r in got.collect()) == ["three", "two"]


def test_clusters_intervals_and_selection(spark):
    v = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.9, 0.4358899]), (1, 12, [0.62, 0.7846018]), (1, 13, [-1.0, 0.0]), (2, 14, [1.0, 0.0])], "c int, k long, e array<float>")
    assert {r.k: r.cluster for r in clustering.single_link(v, "c", "k", "e", 0.86).collect()} == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14}
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (2, 1, 2), (1, 1, 2)], "k int, b int, e int")
    assert sorted(map(tuple, intervals.coalesce_ranges(r, "k", "b", "e").collect())) == [(1, 0, 7, 3), (1, 9, 10, 1), (2, 1, 2, 1)]
    clips = spark.createDataFrame([(1, s, q) for s, n in (("a", 5), ("b", 1)) for q in range(n)], "c int, s string, q int")
    got = ranking.pick_diverse(clips, "c", "s", [F.asc("q")], ["q", "s"], 3, 8)
    assert sorted((r.s, r.q) for r in got.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_the_rest_works_without_the_corpus_parts(tmp_path):
    code = "import sys; sys.modules['assay.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()"
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/assay", tmp_path / "assay", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code.split("\n", 1)[1]], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
