"""Streaming forms: detection of whole documents, and registry lookup as a stream-static join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.functions import text
from markwright.operators import evaluate, registry
from markwright.operators.config import ALPHA, MarkConfig


def detect_batches(vocab: DataFrame, key: bytes, sink: Callable[[DataFrame, int], None], config: MarkConfig = MarkConfig(), alpha: float = ALPHA) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: a document is complete in its batch, so the batch plan applies as it is."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(evaluate.detect_table(batch.select("doc_id", "text"), vocab, key, config, alpha), epoch)

    return run


def lookup_stream(suspects: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, status, record_id for a stream of suspects (doc_id, text) against the static record table."""
    hashed = suspects.withColumn("canonical_hash", text.canonical_hash(text.canonicalize(F.col("text"))))
    return registry.exact_verdicts(hashed, records)


def distinct_stream(stream: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Each canonical text once within the allowed delay."""
    hashed = stream.withColumn("canonical_hash", text.canonical_hash(text.canonicalize(F.col("text"))))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["canonical_hash"])
