"""The dedups go by row: null ids are carried through, repeated ids leave one row."""

import corpus_pipeline

SCHEMA = "doc_id long, text string"


def test_exact_stage_goes_by_row(spark):
    rows = [(None, "only here"), (None, "twice"), (None, "Twice"), (5, "a"), (5, "A"), (5, "b"), (6, "b"), (None, "b"), (5, "c"), (None, None), (None, "")]
    got = corpus_pipeline.exact(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), "")
    assert got.columns == ["doc_id", "text"]
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got.collect()) == [(0, ""), (0, "only here"), (0, "twice"), (5, "a"), (5, "c"), (6, "b")]
    assert corpus_pipeline.exact(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
