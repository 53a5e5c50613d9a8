"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scan, packing, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents but for the last, which returns pieces.
``run`` writes each stage as Parquet in the shared folder and reads it back, so a lost executor costs one stage's tasks.
Both dedups go by row, not by doc_id: rows without doc_id, and rows that repeat one, are kept or dropped like any other.
Null texts count as empty: the quality rules drop them. Further columns, whatever their names, are kept up to packing; an
empty table gives no pieces. Very long texts go through every stage whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mphf_dedup, quality_llr, secret_crf, simhash_near, vector_packing
from waymark.llm.common import free_name, new_folder, numbered, read_table, remove, working_folders, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_llr.keep(docs, read_table(spark, sf_dir, "labels"))


def without(docs: DataFrame, lost_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` less the rows that ``lost_of`` names, given (row, doc_id, text).

    The lost rows' numbers are a written table: Spark broadcasts it if it's small and joins by sorting if not.
    """
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    lost = written(lost_of(rows.select(F.col(row).alias("row"), "doc_id", "text")).select(F.col("row").alias(row)), "lost")
    return rows.join(lost, row, "left_anti").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id (null before numbers), of equal ones the first."""
    return without(docs, mphf_dedup.lost_rows)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more): that of the smallest doc_id."""
    return without(docs, lambda rows: simhash_near.near_rows(rows).filter("NOT kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars brought up to date."""
    out = secret_crf.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return vector_packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near-dedup", near), ("secret scan", secrets), ("packing", packing)]

#: SQL has neither the fingerprints nor the tokens; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's working tables go when it is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        with working_folders(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)  # its rows live on in this stage's
        docs, before = spark.read.parquet(path), path
    return docs
