"""Lines of only the letter f are lines; lines of only a form feed are blank."""

from waymark.llm import quality_llr


def test_form_feed_is_blank_and_f_is_not(spark):
    docs = spark.createDataFrame([(1, "f\nf\n f \n"), (2, "\f\n\f\n\f\x0b\n"), (3, "a\nf\na")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality_llr.judge(docs, labels).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
