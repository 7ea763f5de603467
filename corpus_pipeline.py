"""A corpus pipeline of the operators in ``markwright.llm``.

Stages, in order: quality classifier, near-dedup, benchmark decontamination, mixing to target weights, sharding.
Each takes (spark, docs, sf_dir), works on everything its predecessor kept, and is written as Parquet before the
next one reads it.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markwright.llm import decontamination, mixing, near_dedup, quality, sharding
from markwright.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on ``labels``, accepts."""
    found = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where("predicted = 1").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark``."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row that is left."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: Hash-based samples and trained models have no counterpart in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
