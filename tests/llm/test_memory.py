"""What a task and a waiting worker hold does not grow with Spark's own batch of 10,000 texts."""

import corpus_pipeline
import pyarrow as pa
import pytest

from waymark.llm import quality_llr, secret_crf, simhash_near, vector_packing

SCHEMA = "doc_id long, text string"
BATCH_BYTES = 4 << 20
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def texts(spark):
    spark.conf.unset(KEY)
    yield spark.range(1200).selectExpr("id AS row", "id AS doc_id", "repeat(concat('word', id, ' '), 2000) AS text").coalesce(1)
    spark.conf.unset(KEY)


@pytest.mark.parametrize("stage", [lambda t: secret_crf.redact(t), lambda t: vector_packing.pack_documents(t), lambda t: simhash_near.sets(t, 10)], ids=["secrets", "packing", "sets"])
def test_batches_of_texts_are_bounded_by_bytes(spark, texts, stage):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    stage(texts)
    got = texts.mapInArrow(held, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 1200
    assert max(r["bytes"] for r in got) < 2 * BATCH_BYTES


def test_texts_over_the_bound_stay_whole(spark, texts):
    long = spark.range(3).selectExpr("id AS doc_id", f"repeat('abcd ', {BATCH_BYTES // 4}) AS text").coalesce(1)
    assert [r["n"] for r in secret_crf.redact(long).selectExpr("length(text) AS n").collect()] == [5 * (BATCH_BYTES // 4)] * 3


def test_quality_rules_start_no_python_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(20)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")

    def refuse(*a, **b):
        raise AssertionError("rows go through Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert quality_llr.keep(docs, labels).columns == docs.columns


def test_the_stages_keep_their_results_in_small_batches(spark, texts):
    rows = [(i, f"text {i} " + "password=hunter22 " * (i % 3)) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    spark.conf.set(KEY, 64)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, "").collect()} == whole
    assert spark.conf.get(KEY) == "64"  # a smaller bound stays
