"""Bounded batches of texts for Python workers, and bounded, repeatable samples of rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.session import bounded_batches as bounded_batches

REPEATS = 16


def at_most_repeats(rows: DataFrame, key: str, repeats: int = REPEATS) -> DataFrame:
    """At most ``repeats`` of the rows that share a key, those with the smallest hashes of all their columns.

    The limit is pushed into each task before the exchange, so a key that a third of all rows share costs no more than others.
    """
    order = Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= repeats).drop("_nth")


def under(rate: float) -> Column:
    """Whether ``rank`` lies in the lowest ``rate`` of all 64-bit numbers."""
    return F.lit(True) if rate >= 1 else F.col("rank") < int(rate * 2**64) - 2**63


def hash_sample(rows: DataFrame, key: Column, seed: int, max_rows: int) -> DataFrame:
    """Adds ``rank`` (a hash of the key) and keeps the rows under the quantile at which about ``max_rows`` are expected,
    of one key at most ``REPEATS`` rows.

    A count, a filter and a limit by key: nothing is sorted as a whole or sent to the driver, and reruns keep the same rows.
    """
    count = rows.count()
    ranked = rows.withColumn("rank", F.xxhash64(key, F.lit(seed)))
    return at_most_repeats(ranked.where(under(max_rows / max(count, 1))), "rank")


def stratified_sample(rows: DataFrame, by: str, key: Column, seed: int, max_rows: int) -> DataFrame:
    """Like :func:`hash_sample`, with an equal quota for each value of ``by``: values with fewer rows than the quota keep all of
    theirs, and what they leave is shared by the others.  The driver sees one number for each distinct group size."""
    sizes = rows.groupBy(by).count()
    told = sorted((r["count"], r["groups"]) for r in sizes.groupBy("count").agg(F.count(F.lit(1)).alias("groups")).collect())
    left, groups, quota = float(max_rows), sum(g for _, g in told), float(max_rows)
    for size, many in told:  # the smallest groups first
        quota = left / groups
        if size >= quota:
            break
        left, groups = left - size * many, groups - many
        quota = float("inf")
    ranked = rows.withColumn("rank", F.xxhash64(key, F.lit(seed)))
    place = F.col("rank").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    own = sizes.where(F.col("count") > quota).withColumnRenamed(by, "_group")
    if quota >= 1:
        own = F.broadcast(own)  # at most max_rows / quota groups are larger than the quota, so rows need not move
    kept = ranked.join(own, F.col(by).eqNullSafe(F.col("_group")), "left").where(place < F.coalesce(F.lit(quota) / F.col("count"), F.lit(2.0)))
    return at_most_repeats(kept.drop("_group", "count"), "rank")
