"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_lexicon, hard_negatives, mphf_dedup, piece_rounds, quality_llr, repair_tokens, secret_crf, simhash_gph, suffix_family, tagpath, vector_packing, warc_revisit, welford_whiten
from .common import read_table
from .vector_packing import vocabulary_file


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scan(read_table(spark, sf_dir, "documents"))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.token_files_roundtrip(read_table(spark, sf_dir, "documents"))


def op5_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gph.simhash_components(read_table(spark, sf_dir, "documents"))


def op7_tagpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.resolve_pages(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_mphf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mphf_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rounds.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op12_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return welford_whiten.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_lexicon, op2_quality_llr, op3_secret_crf, op4_repair_tokens, op5_suffix_family, op6_simhash_gph, op7_tagpath, op8_warc_revisit, op9_mphf_dedup, op10_vector_packing, op11_piece_rounds, op12_welford_whitening, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_revisit": warc_revisit.ORACLE, "op9_mphf_dedup": mphf_dedup.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
