"""Statistics as column expressions and DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Stirling's series after shifting the argument up by 10; error under 1e-13."""
    y = x + F.lit(10.0)
    shift = sum((F.log(x + F.lit(float(i))) for i in range(1, 10)), F.log(x))
    series = F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, 3) + F.lit(1 / 1260) / F.pow(y, 5) - F.lit(1 / 1680) / F.pow(y, 7)
    return (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def gamma_tail(statistic: Column, n: Column) -> Column:
    """P(Gamma(n, 1) > statistic) for a whole number n >= 1: the Erlang tail.

    From the largest term outwards, relative to that term, so nothing under- or overflows: above the mean the tail's
    sum over k < n runs down from k = n - 1, below it the complement's sum runs up from k = n.
    """
    s, m = statistic.cast("double"), n.cast("double")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def fold(steps: Column, ratio) -> Column:
        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * ratio(k.cast("double"))
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(steps, one, step, lambda acc: acc["sum"])

    reach = (F.lit(60) + 12 * F.sqrt(m)).cast("int")  # further terms are under 1e-16 of the largest
    down = F.when(n > 1, F.sequence(n - 1, F.greatest(n - 1 - reach, F.lit(1)), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    up = F.sequence(n + 1, n + 1 + reach)
    upper = F.exp(-s + (m - 1) * F.log(s) - log_gamma(m)) * fold(down, lambda k: k / s)
    lower = F.exp(-s + m * F.log(s) - log_gamma(m + 1)) * fold(up, lambda k: s / k)
    return F.when(s <= 0, F.lit(1.0)).when(s >= m, F.least(upper, F.lit(1.0))).otherwise(F.lit(1.0) - lower)


def _tail(s: float, n: int) -> float:
    if s <= 0:
        return 1.0
    log, total, term = -s + (n - 1) * math.log(s) - math.lgamma(n), 1.0, 1.0
    if s >= n:
        for k in range(n - 1, 0, -1):
            term *= k / s
            total += term
            if term < 1e-17 * total:
                break
        return min(1.0, math.exp(log) * total)
    log += math.log(s) - math.log(n)
    k = n
    while term > 1e-17 * total:
        k += 1
        term *= s / k
        total += term
    return 1.0 - math.exp(log) * total


def gamma_quantile(p: float, n: int) -> float:
    """The threshold that Gamma(n, 1) exceeds with probability ``1 - p``, by bisection."""
    low, high = 0.0, n + 20 * math.sqrt(n) + 50.0
    while high - low > 1e-12 * max(1.0, high):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, n) > 1 - p else (low, mid)
        if mid in (low, high) and high - low < 4e-16 * high:
            break
    return (low + high) / 2


def with_threshold(df: DataFrame, alpha: float, n: str = "n_scored") -> DataFrame:
    """Adds ``threshold``: infinite where nothing was scored.  Worked out once for each distinct number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["threshold"] = [gamma_quantile(1 - alpha, int(x)) for x in part["_n"]]
            yield part

    own = df.where(F.col(n) > 0).select(F.col(n).cast("int").alias("_n")).distinct().mapInPandas(run, "_n int, threshold double")
    return df.join(own, F.col(n) == F.col("_n"), "left").drop("_n").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


def neg_log10_p(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two intervals as a share of their hull."""
    inter = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, inter / hull).otherwise(F.lit(0.0))


def value_counts(scores: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Positives and negatives of each distinct score: all that AUC and ROC need, so that the windows
    below run over distinct scores and not over rows."""
    own = scores.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    return own.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum((~F.col(positive)).cast("long")).alias("neg"))


def auc(scores: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with mid-ranks: the chance that a positive scores above a negative, ties half.  Null
    where one side is empty."""
    return auc_of_counts(value_counts(scores, by or [], score, positive), by)


def auc_of_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from rows (score, pos, neg); a score may have several rows."""
    by = by or []
    counts = counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = counts.withColumn("wins", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2))
    total = wins.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg")))).drop("wins")


def roc(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """threshold, fpr, tpr for every distinct score and for infinity, with scores at the threshold counted."""
    counts = value_counts(scores, [], score, positive)
    upto = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    whole = Window.partitionBy(F.lit(0))
    rate = lambda c: F.sum(c).over(upto) / F.sum(c).over(whole)
    points = counts.select(F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))
    top = counts.groupBy().agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(top)


def empirical_threshold(scores: DataFrame, score: str, alpha: float) -> DataFrame:
    """One row: the ascending order statistic at 0-based place ``min(ceil((1 - alpha) n), n - 1)``; infinite without scores.

    Scores are counted first, so the window runs over distinct values.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).count()
    upto = counts.select("score", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("score")).alias("upto"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n"))
    place = F.least(F.greatest(F.ceil(F.lit(1.0 - alpha) * F.col("n")), F.lit(0)), F.col("n") - 1)
    return upto.where(F.col("upto") > place).groupBy().agg(F.coalesce(F.min("score"), F.lit(float("inf"))).alias("threshold"))
