"""The pipeline's stages on a small table, each against what its operator says of its own input."""

import corpus_pipeline
from assay.llm import decontaminate, kit, langid, pii, simhash


def test_each_stage_keeps_what_it_should(spark, sf_dir, tmp_path):
    docs = kit.load(spark, sf_dir, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        had = {r.doc_id: r.text for r in before.collect()}
        seen.append((len(had), len(ids)))
        if name == "language":
            labels = langid.identify(before, langid.fit(before, ~langid.held_out()))
            assert ids == {r.doc_id for r in labels.collect() if r.lang_pred != "und"} and len(ids) >= 0.9 * len(had)
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in simhash.near_duplicates(before).where("doc_id = component_id").collect()}
        elif name == "decontamination":
            index = next(decontaminate.parts(kit.load(spark, sf_dir, "benchmark")))
            assert ids == {i for i, t in had.items() if not decontaminate.search([t], index)[0]}
        elif name == "personal_data":
            assert ids == set(had) and pii.find(docs).where("n_email + n_ip + n_phone > 0").count() == 0
        else:
            assert ids == set(had) and docs.where("not lossless").count() == 0
        if name != "pieces":
            assert docs.columns == columns
    assert any(a > b for a, b in seen)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


def test_empty_and_null_rows_pass(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, None), (2, "hello world of words", "en", "s", None), (2, "hello world of words", "en", "s", None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() == (1 if rows else 0)
