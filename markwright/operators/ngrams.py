"""Tokens, vocabulary and n-gram statistics of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.functions import prf, text
from markwright.operators.config import UNKNOWN, VOCAB_SIZE
from markwright.session import bounded_batches

COUNTED = 1 << 22  # trigrams that a worker counts together
BITS = 21  # of a token's number in a trigram's code


def canonical_docs(docs: DataFrame, compatibility: bool = True) -> DataFrame:
    """doc_id, canon: worked out once and shared by hashing, sentences and detection."""
    return docs.select("doc_id", text.canonicalize(F.col("text"), compatibility).alias("canon"))


def token_lists(docs: DataFrame, column: str = "canon") -> DataFrame:
    """doc_id, tokens."""
    return docs.select("doc_id", text.tokenize(F.col(column)).alias("tokens"))


def token_table(docs: DataFrame, column: str | None = "canon") -> DataFrame:
    """doc_id, pos, token, of a text column or (None) of :func:`token_lists`; a document without tokens keeps one row with a null position."""
    lists = docs if column is None else token_lists(docs, column)
    return lists.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token"))


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(tokens: DataFrame, size: int = VOCAB_SIZE) -> DataFrame:
    """tok_id, token, cnt, le: the ``size - 1`` most frequent tokens from id 1 on (ties by code point) and the unknown token as 0.

    The cut is a distributed top-k; only its ``size`` rows are then numbered in one task.  ``le`` holds
    the id as four bytes, least first, as the keyed functions take it.
    """
    spark = tokens.sparkSession
    top = token_counts(tokens).orderBy(F.desc("cnt"), "token").limit(size - 1)
    numbered = top.select(F.row_number().over(Window.orderBy(F.desc("cnt"), "token")).alias("tok_id"), "token", "cnt")
    unknown = spark.range(1).select(F.lit(0).alias("tok_id"), F.lit(UNKNOWN).alias("token"), F.lit(0).cast("long").alias("cnt"))
    return unknown.unionByName(numbered).withColumn("le", prf.le32(F.col("tok_id")))


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``tok_id`` and ``le``; the vocabulary has a fixed size and is broadcast."""
    own = F.broadcast(vocab.where("tok_id > 0").select("token", "tok_id", "le"))
    joined = tokens.join(own, "token", "left")
    return joined.select("doc_id", "pos", "token", F.coalesce("tok_id", F.lit(0)).alias("tok_id"), F.coalesce("le", F.lit(bytes(4))).alias("le"))


def numbering(vocab: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For Python workers: batches (doc_id, tokens) become batches (doc_id, ids).  The vocabulary has a fixed size and goes along with the tasks."""
    known = vocab.where("tok_id > 0").select("token", "tok_id").collect()
    words, numbers = [r["token"] for r in known], [*(r["tok_id"] for r in known), 0]
    bounded_batches(vocab.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.array(numbers, np.int32)
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten()
            ids = found[pc.index_in(flat, value_set=pa.array(words, flat.type)).fill_null(-1).to_numpy()]
            ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode_lists(lists: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, ids: the numbers of a document's tokens in order, of :func:`token_lists`; no list counts as an empty one.

    A document stays one row, so nothing that looks at its tokens in order needs an exchange.
    """
    return lists.select("doc_id", "tokens").mapInArrow(numbering(vocab), T.StructType([lists.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def id_lists(encoded: DataFrame) -> DataFrame:
    """doc_id, ids, of :func:`encode_lists` as it is, or of the rows of :func:`encode`, which are first gathered by document."""
    if "ids" in encoded.columns:
        return encoded
    placed = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "tok_id"))))
    return encoded.groupBy("doc_id").agg(placed.alias("_placed")).select("doc_id", F.col("_placed.tok_id").alias("ids"))


def unigram_probs(encoded: DataFrame, vocab: DataFrame, alpha: float = 0.1) -> DataFrame:
    """tok_id, p: additive smoothing over the whole vocabulary."""
    rows = encoded.select(F.explode("ids").alias("tok_id")) if "ids" in encoded.columns else encoded.where(F.col("pos").isNotNull())
    counts = rows.groupBy("tok_id").agg(F.count(F.lit(1)).alias("c"))
    every = vocab.select("tok_id").join(counts, "tok_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = Window.partitionBy(F.lit(0))  # as many rows as the vocabulary has
    return every.select("tok_id", ((F.col("c") + alpha) / (F.sum("c").over(whole) + alpha * F.count(F.lit(1)).over(whole))).alias("p"))


def ngram_rows(encoded: DataFrame) -> DataFrame:
    """doc_id, pos, w1, w2, w: each token with the two before it in its document (nulls at the start); of :func:`encode_lists` without an exchange."""
    if "ids" in encoded.columns:
        none = F.lit(None).cast("int")
        shifted = F.arrays_zip(F.concat(F.array(none, none), "ids").alias("w1"), F.concat(F.array(none), "ids").alias("w2"), F.col("ids").alias("w"))
        rows = encoded.select("doc_id", F.posexplode(shifted).alias("pos", "_n"))
        return rows.select("doc_id", "pos", "_n.w1", "_n.w2", "_n.w").where(F.col("w").isNotNull())
    order = Window.partitionBy("doc_id").orderBy("pos")
    return encoded.where(F.col("pos").isNotNull()).select("doc_id", "pos", F.lag("tok_id", 2).over(order).alias("w1"), F.lag("tok_id", 1).over(order).alias("w2"), F.col("tok_id").alias("w"))


def bigram_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("w2").isNotNull()).groupBy(F.col("w2").alias("w1"), "w").agg(F.count(F.lit(1)).alias("cnt"))


def trigram_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("w1").isNotNull()).groupBy("w1", "w2", "w").agg(F.count(F.lit(1)).alias("cnt"))


def trigram_counts_by_context(lists: DataFrame, vocab: DataFrame) -> DataFrame:
    """:func:`trigram_counts` of :func:`token_lists`, dealt out by the two words of the context, so that what adds up by context needs no further exchange.

    Workers count ``COUNTED`` trigrams at a time; only those counts are shuffled.
    """
    numbered = numbering(vocab)

    def counted(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, cnt = np.unique(np.concatenate(codes), return_counts=True)
        words = [(found >> shift & (1 << BITS) - 1).astype(np.int32) for shift in (2 * BITS, BITS, 0)]
        for at in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([*(pa.array(w[at : at + (1 << 16)]) for w in words), pa.array(cnt[at : at + (1 << 16)], pa.int64())], ["w1", "w2", "w", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for batch in numbered(batches):
            sizes = pc.list_value_length(batch.column("ids")).to_numpy()
            ids = batch.column("ids").flatten().to_numpy().astype(np.int64)
            if ids.max(initial=0) >> BITS:
                raise ValueError(f"a vocabulary of more than {1 << BITS} tokens")
            full = np.flatnonzero(np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= 2)
            codes.append(ids[full - 2] << 2 * BITS | ids[full - 1] << BITS | ids[full])
            held += len(full)
            if held >= COUNTED:
                yield from counted(codes)
                codes, held = [], 0
        if held:
            yield from counted(codes)

    parts = lists.select("doc_id", "tokens").mapInArrow(run, "w1 int, w2 int, w int, cnt long")
    return parts.repartition("w1", "w2").groupBy("w1", "w2", "w").agg(F.sum("cnt").alias("cnt"))


def _with_totals(counts: DataFrame) -> DataFrame:
    """Counts with the totals of their context beside them; a context has as many rows as it has continuations, at most one for each token of the vocabulary."""
    own = Window.partitionBy(*[c for c in counts.columns if c not in ("w", "cnt")])
    return counts.withColumns({"total": F.sum("cnt").over(own), "types": F.count(F.lit(1)).over(own)})


def interpolated_probs(bigrams: DataFrame, trigrams: DataFrame, unigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """w1, w2, w, p for every seen trigram: absolute discounting, trigram over bigram over unigram."""
    two = _with_totals(bigrams).join(F.broadcast(unigrams.select(F.col("tok_id").alias("w"), F.col("p").alias("p1"))), "w")
    p2 = F.greatest(F.col("cnt") - discount, F.lit(0.0)) / F.col("total") + F.lit(discount) * F.col("types") / F.col("total") * F.col("p1")
    two = two.select(F.col("w1").alias("w2"), "w", p2.alias("p2"))
    three = _with_totals(trigrams).join(two, ["w2", "w"])
    p3 = F.greatest(F.col("cnt") - discount, F.lit(0.0)) / F.col("total") + F.lit(discount) * F.col("types") / F.col("total") * F.col("p2")
    return three.select("w1", "w2", "w", p3.alias("p"))
