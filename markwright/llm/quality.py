"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Tokens are words (in their own case) and runs of punctuation; unigrams and bigrams are hashed to
``2**bits`` slots, weighted by ``1 + log(count)`` and scaled to unit length.  Training is FTRL-proximal, one update
for each example and weight.  A score is the logistic of a sparse dot product.

The fit uses about ``max_rows`` labelled rows at most (those with the smallest hashes of doc_id, so reruns
agree and the sample is uniform); their features are made on the executors and one task learns
from them.  The model has a fixed size (``2**bits`` floats), whatever the input, and is broadcast.  Scoring covers every whole text.

Defined results: a null text scores as an empty one (the bias alone); rows with a null doc_id or a
null label do not teach; with no labelled rows at all every score is 0.5; of several labels for a
doc_id each counts; repeated rows get the same score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.hashing import U64, batches, mix, token_hashes
from markwright.llm.sampling import bounded_batches, hash_sample

BITS = 18
MAX_ROWS = 12_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.0
UPDATES = 100_000  # examples learned from at least, in whole passes over the sample


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets): each text's distinct slots, the last one the bias, and their values."""
    words, at = token_hashes(texts, lower=False, punctuation=True)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    pair = row[1:] == row[:-1]
    two = mix(words[:-1] * U64(0xA24BAED4963EE407) + words[1:])[pair] if len(words) else words
    rows = np.concatenate([row, row[1:][pair] if len(words) else row])
    slots = (np.concatenate([words, two]) >> U64(64 - bits)).astype(np.int64)
    keys, counts = np.unique(rows << bits | slots, return_counts=True)
    rows, slots = keys >> bits, keys & ((1 << bits) - 1)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(rows, value * value, len(texts)))
    value = value / norm[rows]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(texts)), out=offsets[1:])
    return slots, value, offsets


class Ftrl:
    """FTRL-proximal for logistic loss; the last weight is the bias, which is not regularised."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(sample: DataFrame, bits: int = BITS) -> np.ndarray:
    """Weights (float32, ``2**bits`` and the bias) from rows text, label, rank."""

    def prepare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            for a, b in batches(texts, 1 << 19):
                slots, values, at = features([t if isinstance(t, str) else None for t in texts[a:b]], bits)
                cut = [(slots[at[i] : at[i + 1]].astype("<i4").tobytes(), values[at[i] : at[i + 1]].astype("<f4").tobytes()) for i in range(b - a)]
                yield pd.DataFrame({"rank": part["rank"].iloc[a:b].to_numpy(), "label": part["label"].iloc[a:b].to_numpy(), "slots": [c[0] for c in cut], "values": [c[1] for c in cut]})

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in parts:
            columns = (part.column(c).to_pylist() for c in ("rank", "slots", "label", "values"))
            rows += [(rank, slots, float(label), np.frombuffer(values, "<f4")) for rank, slots, label, values in zip(*columns, strict=True)]
        rows.sort(key=lambda r: r[:3])
        model = Ftrl(1 << bits)
        for _ in range(-(-UPDATES // max(len(rows), 1))):
            for _, slots, label, values in rows:
                model.learn(np.frombuffer(slots, "<i4"), values.astype(float), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(np.arange(len(model.z))).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    prepared = sample.mapInPandas(prepare, "rank long, label int, slots binary, values binary")
    row = prepared.repartition(1).mapInArrow(fit, "weights binary").first()
    return np.frombuffer(row[0], "<f4") if row else np.zeros((1 << bits) + 1, "<f4")


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, label, rank of the labelled rows with the smallest hashes that may teach: crc32(doc_id) mod 5 is not 0.

    The labels that may teach are cut to ``max_rows`` before they meet the texts, so that the texts
    are filtered where they are read.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    few = hash_sample(own, F.col("doc_id"), 11, max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label", "rank")  # about max_rows rows at most


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes for each of the 2**bits slots
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for part in parts:
            texts = part.column("text").to_pylist()
            out = np.full(len(texts), w[-1])
            for a, b in batches(texts, 1 << 19):
                slots, values, at = features(texts[a:b], bits)
                row = np.repeat(np.arange(b - a), np.diff(at))
                out[a:b] += np.bincount(row, w[slots] * values, b - a)
            scores = pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))
            yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``predicted``; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    weights = train(labelled_sample(docs, labels, max_rows))
    scored = score(docs.drop("score", "predicted"), weights)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    found = classify(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
