"""Queries of the corpus operators, and the SQL that states the results of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, interpolation, langid, licenses, line_rules, media, mixing, ngram_join, secrets, sql, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_query(_documents(spark, sf_dir))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.interpolation_query(_documents(spark, sf_dir))


def op3_png_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_query(_documents(spark, sf_dir))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_query(_documents(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_query(_documents(spark, sf_dir))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_query(_documents(spark, sf_dir))


def op8_word_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_query(_documents(spark, sf_dir))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(_documents(spark, sf_dir))


def tokenizer_path() -> str:
    """The vocabulary file of op10, which every node has where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_query(_documents(spark, sf_dir), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_ownership, op2_deleted_interpolation, op3_png_cosine, op4_line_rules, op5_ngram_jaccard, op6_kneser_ney, op7_license_sentences, op8_word_first, op9_entropy_mixing, op10_bpe_tree)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ownership": sql.secrets_sql(), "op4_line_rules": sql.lines_sql(), "op7_license_sentences": sql.licenses_sql()}
