"""Evaluation: null calibration and one row of metrics for each attack, from one wide plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.functions import stats, text
from markwright.operators import detect, ngrams, registry, retrieval
from markwright.operators.config import ALPHA, MarkConfig


def detect_table(texts: DataFrame, vocab: DataFrame, key: bytes, config: MarkConfig = MarkConfig(), alpha: float = ALPHA, canonical: bool = True) -> DataFrame:
    """Detections of texts (doc_id, text)."""
    body = ngrams.canonical_docs(texts) if canonical else texts.select("doc_id", F.col("text").alias("canon"))
    return detect.tested_scores(detect.document_scores(ngrams.token_lists(body), key, config, vocab), alpha)


def localized(texts: DataFrame, vocab: DataFrame, key: bytes, config: MarkConfig = MarkConfig(), window: int = 100, stride: int = 20, alpha: float = ALPHA) -> DataFrame:
    lists = ngrams.token_lists(ngrams.canonical_docs(texts))
    return detect.segments(detect.document_windows(lists, key, config, window, stride, vocab), window, alpha)


def best_overlap(truth: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, best: the largest overlap of the true span (span_start, span_end) with a found segment, 0 without one."""
    joined = truth.join(segments.select("doc_id", "token_start", "token_end"), "doc_id", "left")
    share = F.when(F.col("token_start").isNotNull(), stats.iou(F.col("span_start"), F.col("span_end"), F.col("token_start"), F.col("token_end"))).otherwise(F.lit(0.0))
    return joined.groupBy("doc_id").agg(F.max(share).alias("best"))


def null_summary(null: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """n, fpr, mean_scored_tokens and the empirical threshold of detections of unmarked texts."""
    told = null.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("double")).alias("fpr"), F.avg("n_scored").alias("mean_scored_tokens"))
    return told.crossJoin(F.broadcast(stats.empirical_threshold(null, "neg_log10_p", alpha)))  # one row each


def attack_report(attacked: DataFrame, originals: DataFrame, null: DataFrame, vocab: DataFrame, key: bytes, config: MarkConfig = MarkConfig(), alpha: float = ALPHA, records: DataFrame | None = None, index: DataFrame | None = None, public: bytes | None = None) -> DataFrame:
    """One row for each attack.

    attacked: rows of ``attacks.apply``; originals: doc_id, text; null: detections of unmarked texts.  Each attacked text is
    detected with and without canonical text, compared with its original, searched and verified (given
    ``records`` and ``index``, whose doc_id is a record id equal to the original's doc_id), and localised where the true span is known.
    """
    keyed = attacked.withColumn("uid", F.xxhash64("attack", "doc_id"))
    texts = keyed.select(F.col("uid").alias("doc_id"), F.col("attacked_text").alias("text"))
    hard = detect_table(texts, vocab, key, config, alpha).select(F.col("doc_id").alias("uid"), "detected", "z_score", "n_scored", "neg_log10_p")
    naive = detect_table(texts, vocab, key, config, alpha, canonical=False).select(F.col("doc_id").alias("uid"), F.col("detected").alias("naive"), F.col("z_score").alias("z_naive"))
    pairs = keyed.join(originals.select("doc_id", F.col("text").alias("source")), "doc_id").select("uid", text.canonicalize(F.col("source")).alias("original"), text.canonicalize(F.col("attacked_text")).alias("suspect"))
    changed = registry.with_diff(pairs).select("uid", "changed_fraction")
    spans = keyed.where(F.col("span_start").isNotNull()).select(F.col("uid").alias("doc_id"), "span_start", "span_end", F.col("attacked_text").alias("text"))
    best = best_overlap(spans.drop("text"), localized(spans.select("doc_id", "text"), vocab, key, config, alpha=alpha)).withColumnRenamed("doc_id", "uid")
    rows = keyed.select("uid", "attack", "tier", "doc_id").join(hard, "uid").join(naive, "uid").join(changed, "uid").join(best, "uid", "left")
    if records is not None:
        verdicts = registry.verify(texts, records, index, public).select(F.col("doc_id").alias("uid"), "status")
        hits = retrieval.search(ngrams.canonical_docs(texts), index, k=1).select(F.col("query_id").alias("uid"), F.col("doc_id").alias("hit"))
        rows = rows.join(verdicts, "uid").join(hits, "uid", "left").withColumn("recalled", F.coalesce(F.col("hit") == F.col("doc_id"), F.lit(False)))
    else:
        rows = rows.withColumns({"status": F.lit("unknown"), "recalled": F.lit(False)})
    share = lambda c: F.avg(c.cast("double"))
    threshold = F.broadcast(stats.empirical_threshold(null, "neg_log10_p", alpha))
    report = rows.crossJoin(threshold).groupBy("attack", "tier").agg(  # one threshold
        F.count(F.lit(1)).alias("n"), F.avg("changed_fraction").alias("tokens_changed_frac"),
        share(F.col("detected")).alias("tpr_analytic_hardened"), share(F.col("naive")).alias("tpr_analytic_naive"), share(F.col("neg_log10_p") >= F.col("threshold")).alias("tpr_empirical_hardened"),
        F.avg("z_score").alias("mean_z_hardened"), F.avg("z_naive").alias("mean_z_naive"), F.avg("n_scored").alias("mean_scored_tokens"),
        share(F.col("recalled")).alias("retrieval_recall_at_1"), *[share(F.col("status") == s).alias(f"registry_{s}") for s in ("exact", "normalized", "tampered", "unknown")],
        share(F.col("detected") | F.col("recalled") | (F.col("status") != "unknown")).alias("stack_attributed"), F.avg("best").alias("localization_mean_iou"), share(F.col("best") > 0.3).alias("localization_found_rate"),
    )
    # scores are counted before the null ones are repeated for each attack
    hits = rows.groupBy("attack", "neg_log10_p").agg(F.count(F.lit(1)).alias("pos")).withColumn("neg", F.lit(0).cast("long"))
    misses = null.groupBy("neg_log10_p").agg(F.count(F.lit(1)).alias("neg")).withColumn("pos", F.lit(0).cast("long"))
    every = hits.unionByName(misses.join(F.broadcast(rows.select("attack").distinct()), F.lit(True)))  # as many attacks as the catalog has
    area = stats.auc_of_counts(every.withColumnRenamed("neg_log10_p", "score"), ["attack"])
    return report.join(area.select("attack", F.col("auc").alias("auc_hardened")), "attack")


def human_windows(docs: DataFrame, n: int, words: int, seed: int = 0) -> DataFrame:
    """doc_id (0 to ``n - 1``), text: ``n`` windows of ``words`` words that start at random places of the documents (doc_id, canon).

    A window lies in one document and starts at any place with the same probability; documents of fewer words have one window of all they have.
    """
    sized = docs.where(F.col("canon") != "").withColumn("_w", F.filter(F.split("canon", rf"{text.SPACE}+"), lambda w: w != ""))
    places = sized.withColumn("_n", F.greatest(F.size("_w") - words + 1, F.lit(1)).cast("long"))
    # Efraimidis-Spirakis: the smallest -log(u) / weight; each of the n draws is the top-1 of its own hash
    draw = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("draw")
    u = lambda *more: (F.shiftrightunsigned(F.xxhash64("doc_id", "draw", *[F.lit(m) for m in (seed, *more)]), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    keyed = places.select("doc_id", "_n", draw).select("doc_id", "_n", "draw", (-F.log(u(1)) / F.col("_n")).alias("key"))
    first = keyed.groupBy("draw").agg(F.min_by(F.struct("doc_id", "_n"), "key").alias("d"))
    start = F.floor(u(2) * F.col("_n")).cast("int") + 1
    picked = first.select("draw", F.col("d.doc_id").alias("doc_id"), F.col("d._n").alias("_n")).withColumn("_at", start)
    joined = picked.join(sized.select("doc_id", "_w"), "doc_id")
    return joined.select(F.col("draw").alias("doc_id"), F.array_join(F.slice("_w", F.col("_at"), F.lit(words)), " ").alias("text"))


def distinct_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """rate: the share of prompts whose texts differ between two runs (doc_id, ids)."""
    both = first.select("doc_id", F.col("ids").alias("a")).join(second.select("doc_id", F.col("ids").alias("b")), "doc_id")
    return both.agg(F.avg((~F.col("a").eqNullSafe(F.col("b"))).cast("double")).alias("rate"))
