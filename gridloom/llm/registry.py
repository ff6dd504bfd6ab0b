"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import anisotropic_search, line_dedup, merkle, mil_quality, mixing, ngram_join, passages, pieces, toxicity, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("version")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_anisotropic_search, op2_ngram_join, op3_url_rules, op4_toxicity, op5_passages, op6_merkle, op7_sentencepiece, op8_mixing, op9_line_dedup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.ORACLE, "op3_url_rules": url_rules.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
