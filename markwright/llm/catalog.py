"""Queries of the operators in this package, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markwright.llm import decontamination, language, licenses, line_dedup, mixing, near_dedup, neighbours, personal_data, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_minhash_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents"))


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op7_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op10_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_histogram_sharding, op2_simhash_decontamination, op3_minhash_licenses, op4_skip_chain_pii, op5_ftrl_quality, op6_line_runs, op7_probminhash_near_dedup, op8_projected_neighbours, op9_pareto_mixing, op10_word_backoff_language)
}
#: The others train models or use hashes and searches that DuckDB lacks; tests hold them against brute force.
ORACLES = {"op6_line_runs": line_dedup.ORACLE_SQL}
