"""Registry of signed records and verdicts on suspect texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions import ed25519, text
from markwright.operators import retrieval
from markwright.session import materialize

RECORD = "id long, canonical_hash string, text string, model string, created string, signature binary"
DIFF = "array<struct<op:string,original:string,suspect:string,orig_tokens:struct<start:int,end:int>,susp_tokens:struct<start:int,end:int>>>"


SALTS = 1024


def assign_ids(rows: DataFrame, order: list[str], start: int = 0, derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``id`` from ``start + 1`` on in the given order, without sorting all rows in one task.

    Rows are range-partitioned and sorted, and each is written once with the number of its task and its place in it; ids
    are then worked out from what was written, by the rows of the tasks before.  Rows that agree in all columns of
    ``order`` are numbered in any order; a salt spreads them over tasks.  ``rows`` are worked out twice, the first time for the
    ranges; costly columns are better ``derived``, once, from the written rows.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    placed = rows.withColumn("_salt", salt).repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # task number in the upper 31 bits
    task = F.shiftright("_at", 33)
    counts = placed.groupBy(task.alias("_task")).count().withColumn("_ahead", F.sum("count").over(Window.orderBy("_task")) - F.col("count"))  # a row for each task
    numbered = placed.withColumns({**(derived or {}), "_task": task}).join(F.broadcast(counts.drop("count")), "_task")
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("id", F.lit(start + 1).cast("long") + F.col("_ahead") + own).drop("_at", "_task", "_ahead")


def signed(records: DataFrame, secret: bytes) -> DataFrame:
    """Adds ``signature``: Ed25519 over domain, hash, model and time."""

    @F.pandas_udf("binary")
    def sign(message: pd.Series) -> pd.Series:
        return message.map(lambda m: ed25519.sign(secret, m.encode()))

    return records.withColumn("signature", sign(text.message(F.col("canonical_hash"), F.col("model"), F.col("created"))))


def register(rows: DataFrame, secret: bytes | None, created: str, model: str = "", start: int = 0) -> DataFrame:
    """Records for rows (text, and the columns that order them): one id each, duplicates allowed."""
    if secret is None:
        raise RuntimeError("registering needs a signing key")
    order = [c for c in rows.columns if c != "text"]
    hashed = assign_ids(rows, order, start, {"canonical_hash": text.canonical_hash(text.canonicalize(F.col("text")))})
    return signed(hashed.withColumns({"model": F.lit(model), "created": F.lit(created)}), secret).select("id", "canonical_hash", "text", "model", "created", "signature")


def first_by_hash(records: DataFrame) -> DataFrame:
    """The record with the lowest id for each hash."""
    return records.groupBy("canonical_hash").agg(F.min_by(F.struct(*[c for c in records.columns if c != "canonical_hash"]), "id").alias("record"))


def lookup(suspects: DataFrame, records: DataFrame) -> DataFrame:
    """Suspects (doc_id, text, canonical_hash) with the first record of their hash, or null."""
    return suspects.join(first_by_hash(records), "canonical_hash", "left")


def exact_verdicts(suspects: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, status, record_id: exact for the registered bytes, normalized for other bytes of the same canonical text, else unknown."""
    found = lookup(suspects, records)
    status = F.when(F.col("record").isNull(), "unknown").when(F.col("text") == F.col("record.text"), "exact").otherwise("normalized")
    return found.select("doc_id", status.alias("status"), F.col("record.id").alias("record_id"))


def token_diff(original: str, suspect: str) -> tuple[list[tuple], float]:
    """What lies between the words that two canonical texts share in order: (kind, words of both, spans of both), and the changed share."""
    old, new = original.split(), suspect.split()
    spans, i, j, changed = [], 0, 0, 0
    for a, b, size in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks():
        if a > i or b > j:
            kind = "insert" if a == i else "delete" if b == j else "replace"
            spans.append((kind, " ".join(old[i:a]), " ".join(new[j:b]), (i, a), (j, b)))
            changed += max(a - i, b - j)
        i, j = a + size, b + size
    return spans, changed / max(len(old), len(new), 1)


def with_diff(rows: DataFrame, original: str = "original", suspect: str = "suspect") -> DataFrame:
    """Adds ``diff`` and ``changed_fraction`` for two canonical text columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [token_diff(x or "", y or "") for x, y in zip(part[original], part[suspect], strict=True)]
            part["diff"] = [[{"op": o, "original": a, "suspect": b, "orig_tokens": {"start": i[0], "end": i[1]}, "susp_tokens": {"start": j[0], "end": j[1]}} for o, a, b, i, j in spans] for spans, _ in found]
            part["changed_fraction"] = [share for _, share in found]
            yield part

    schema = rows.withColumns({"diff": F.lit(None).cast(DIFF), "changed_fraction": F.lit(0.0)}).schema
    return rows.mapInPandas(run, schema)


def with_validity(rows: DataFrame, public: bytes | None) -> DataFrame:
    """Adds ``signature_valid`` for rows with the columns of a record; false without a public key."""

    @F.pandas_udf("boolean")
    def valid(message: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([m is not None and s is not None and public is not None and ed25519.verify(public, m.encode(), bytes(s)) for m, s in zip(message, signature, strict=True)])

    message = text.message(F.col("canonical_hash"), F.col("model"), F.col("created"))
    return rows.withColumn("signature_valid", valid(message, F.col("signature")))


def verify(suspects: DataFrame, records: DataFrame, index: DataFrame | None = None, public: bytes | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, status, record_id, similarity, signature_valid, changed_fraction, diff for suspects (doc_id, text).

    Suspects with a registered canonical hash are settled by it.  The others are searched in the index of
    sentences (doc_id is a record id there); the top hit counts if its score reaches the threshold or two
    of its sentences match strongly, and is then compared word by word.
    """
    canon = materialize(suspects.select("doc_id", "text", text.canonicalize(F.col("text")).alias("canon")), "suspects")  # three branches read it
    hashed = canon.withColumn("canonical_hash", text.canonical_hash(F.col("canon")))
    found = lookup(hashed, records)
    empty = F.array().cast(DIFF)
    known = found.where(F.col("record").isNotNull()).select(
        "doc_id", F.when(F.col("text") == F.col("record.text"), "exact").otherwise("normalized").alias("status"), F.col("record.id").alias("record_id"), F.lit(1.0).alias("similarity"),
        "canonical_hash", F.col("record.model").alias("model"), F.col("record.created").alias("created"), F.col("record.signature").alias("signature"), F.lit(0.0).alias("changed_fraction"), empty.alias("diff"),
    )
    rest = found.where(F.col("record").isNull()).select("doc_id", "canon")
    if index is None:
        hits = rest.withColumns({"rec": F.lit(None).cast("long"), "score": F.lit(0.0), "n_strong": F.lit(0)})
    else:
        top = retrieval.search(rest, index, k=1).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("rec"), "score", "n_strong")
        hits = rest.join(top, "doc_id", "left").fillna(0.0, ["score"]).fillna(0, ["n_strong"])
    near = F.col("rec").isNotNull() & ((F.col("score") >= threshold) | (F.col("n_strong") >= 2))
    own = records.select(F.col("id").alias("rec"), "canonical_hash", text.canonicalize(F.col("text")).alias("original"), "model", "created", "signature")
    tampered = with_diff(hits.where(near).join(own, "rec").withColumnRenamed("canon", "suspect"))
    tampered = tampered.select("doc_id", F.lit("tampered").alias("status"), F.col("rec").alias("record_id"), F.col("score").alias("similarity"), "canonical_hash", "model", "created", "signature", "changed_fraction", "diff")
    settled = with_validity(known.unionByName(tampered), public).drop("canonical_hash", "model", "created", "signature")
    unknown = hits.where(~near).select("doc_id", F.lit("unknown").alias("status"), F.lit(None).cast("long").alias("record_id"), F.col("score").alias("similarity"), F.lit(0.0).alias("changed_fraction"), empty.alias("diff"), F.lit(None).cast("boolean").alias("signature_valid"))
    return settled.unionByName(unknown)
