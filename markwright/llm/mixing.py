"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  Every document of it gets ``floor(target / size)``
certain whole copies; what is left of the target is filled by one more copy of some documents.
These are chosen by Pareto order sampling: a document with inclusion probability p and a uniform
number u (a hash of the row) ranks by ``(u / (1 - u)) / (p / (1 - p))``, and the lowest ranks are
taken up to the words that are left.  p is that source's remaining share, so it differs by source.

The cut in a source's ranking is found by counting words in buckets of u and narrowing to the
bucket that holds it, so no source is gathered in a task; only the at most few hundred documents
around the cut are looked at one by one: in rank order, each is taken if it still fits.  Where a long document at the cut leaves words
unfilled, the search goes on behind the cut among documents that fit, until less than ``REST`` of the target is left or nothing fits.

u depends on all columns of a row, so rows that share it agree in everything.  If such rows straddle the cut,
as many of them are taken as fit; they are counted, not gathered.

Targets: the sources are numbered without a sort in one task, and the level up to which targets are capped is found by counting
sources in buckets of the ratio at which they are capped.

Defined results: a null or empty text has size 0 and is taken 0 words; null is a source of its own, last in
order; a source without words has target 0; repeated rows are separate documents; an empty table
gives no rows.  Reruns agree: nothing depends on partitions or on the clock.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.operators.registry import assign_ids
from markwright.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
NEAR = 256  # documents that the bucket with the cut should have
FAN = 4096  # most buckets for a source in one pass
REST = 0.002  # of a target
LEVELS = 4096  # distinct ratios that the driver may see
CHUNK = 10_000  # copies of a row that one task writes


def sized(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows with ``_mix_size`` (words) and ``_mix_u`` (uniform in (0, 1), from all columns and the seed)."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source")], F.xxhash64(*docs.columns)), 11)
    return docs.withColumns({"_mix_size": words, "_mix_u": (bits + F.lit(0.5)) * F.lit(2.0**-53)})


def _level(capped: DataFrame) -> float:
    """The level at which ``sum(least(cap, level * weight))`` is the budget, for rows (cap, weight, source_size)."""
    total = capped.agg(F.sum("source_size")).first()[0] or 0
    if not total:
        return 0.0
    ratios = materialize(capped.groupBy((F.col("cap") / F.col("weight")).alias("ratio")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")), "mix-ratios")
    budget, low, high = SHARE * total, 0.0, float(ratios.agg(F.max("ratio")).first()[0])
    spent, every = 0.0, float(ratios.agg(F.sum("weight")).first()[0])  # caps below the interval, weights from there on
    while True:
        inside = ratios.where((F.col("ratio") > low) & (F.col("ratio") <= high)) if low else ratios.where(F.col("ratio") <= high)
        if inside.count() <= LEVELS:
            break
        width = (high - low) / 256
        bucket = F.least(F.lit(255), F.greatest(F.lit(0), F.ceil((F.col("ratio") - low) / width).cast("int") - 1))
        told = inside.groupBy(bucket.alias("b")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.min("ratio").alias("least"), F.max("ratio").alias("most")).orderBy("b").collect()
        for i, r in enumerate(told):
            # with all of this bucket capped, is the level still above it?
            if i == len(told) - 1 or budget - spent - r["cap"] < r["most"] * (every - r["weight"]):
                low, high = (told[i - 1]["most"] if i else low), r["most"]
                break
            spent, every = spent + r["cap"], every - r["weight"]
    for r in sorted(inside.collect(), key=lambda r: r["ratio"]):
        if budget - spent <= r["ratio"] * every:
            break
        spent, every = spent + r["cap"], every - r["weight"]
    return (budget - spent) / every if every else high


def source_targets(rows: DataFrame) -> DataFrame:
    """source, _mix_words, _mix_docs, _mix_target: one row for each source."""
    sources = rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    placed = assign_ids(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("id") % len(WEIGHTS) + 1).cast("int"))
    capped = placed.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(CAP)})
    target = F.least("cap", F.lit(_level(capped)) * F.col("weight"))
    return capped.select("source", F.col("source_size").alias("_mix_words"), F.col("docs").alias("_mix_docs"), target.alias("_mix_target"))


def _on_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join on source with nulls equal; ``table`` has one row for each source.  Spark broadcasts it if its files are small, else splits skewed sources."""
    own = table.withColumnRenamed("source", "_mix_source")
    return rows.join(own, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")


_U = "_mix_u"


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Narrows ``_mix_low`` .. ``_mix_high`` of each source to about ``NEAR`` documents or to one value of u.

    ``_mix_docs`` is the number of documents in between, ``_mix_left`` the words to be filled there, ``_mix_same`` whether they share u.  Documents
    of more than ``_mix_fit`` words are not counted.
    """
    plan = plan.withColumn("_mix_same", F.lit(False))
    while plan.where((F.col("_mix_docs") > 2 * NEAR) & ~F.col("_mix_same")).limit(1).count():
        plan = plan.withColumn("_mix_fan", F.when((F.col("_mix_docs") > 2 * NEAR) & ~F.col("_mix_same"), F.least(F.lit(FAN), F.ceil(F.col("_mix_docs") / NEAR))).otherwise(F.lit(0)).cast("int"))
        width = (F.col("_mix_high") - F.col("_mix_low")) / F.col("_mix_fan")
        own = plan.where("_mix_fan > 0").select("source", "_mix_low", "_mix_high", "_mix_fan", "_mix_fit")
        inside = _on_source(rows, own).where((F.col(_U) >= F.col("_mix_low")) & (F.col(_U) < F.col("_mix_high")) & (F.col("_mix_size") <= F.col("_mix_fit")))
        bucket = F.least(F.col("_mix_fan") - 1, F.floor((F.col(_U) - F.col("_mix_low")) / width).cast("int"))
        told = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("n"), F.min(_U).alias("least"), F.max(_U).alias("most"))
        upto = told.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))  # at most FAN rows each
        at = _on_source(upto, plan.select("source", "_mix_left")).where(F.col("upto") > F.col("_mix_left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "n", "least", "most")).alias("c"))
        joined = plan.join(at.withColumnRenamed("source", "_mix_source"), F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
        idle, none = F.col("_mix_fan") == 0, F.col("c").isNull()  # without a crossing all that is inside fits: the cut is at the upper end
        plan = materialize(
            joined.select(
                "source", "_mix_words", "_mix_target", "_mix_copies", "_mix_fit",
                F.when(idle, F.col("_mix_left")).when(none, F.lit(0.0)).otherwise(F.col("_mix_left") - (F.col("c.upto") - F.col("c.words"))).alias("_mix_left"),
                F.when(idle, F.col("_mix_low")).when(none, F.col("_mix_high")).otherwise(F.col("c.least")).alias("_mix_low"),
                F.when(idle | none, F.col("_mix_high")).otherwise(F.col("c.most") + F.lit(2.0**-54)).alias("_mix_high"),
                F.when(idle, F.col("_mix_docs")).when(none, F.lit(0)).otherwise(F.col("c.n")).alias("_mix_docs"),
                F.when(idle, F.col("_mix_same")).when(none, F.lit(True)).otherwise(F.col("c.least") == F.col("c.most")).alias("_mix_same"),
            ),
            "mix-plan",
        )
    return plan


def plan_mix(rows: DataFrame) -> list[DataFrame]:
    """For each round and source: copies that are certain, and the range of u that holds the cut.

    Rows that fit, with ``_mix_u`` from ``_mix_from`` to ``_mix_low``, get one more copy; between ``_mix_low`` and ``_mix_high`` ``_mix_left`` words are to
    be filled in rank order.  The first round has all rows before it, later ones what lies behind the round before.
    """
    words = F.col("_mix_words")
    copies = F.when(words > 0, F.floor(F.col("_mix_target") / words)).otherwise(0).cast("int")
    plan = materialize(source_targets(rows), "mix-targets").withColumn("_mix_copies", copies)
    first = plan.withColumns({"_mix_left": F.col("_mix_target") - F.col("_mix_copies") * words, "_mix_low": F.lit(0.0), "_mix_high": F.lit(1.0), "_mix_fit": F.lit((1 << 62))})
    rounds = [materialize(_cut(rows, first).withColumn("_mix_from", F.lit(0.0)), "mix-round")]
    while True:
        last = rounds[-1]
        around = _on_source(rows, last).where((F.col(_U) >= F.col("_mix_low")) & (F.col(_U) < F.col("_mix_high")) & (F.col("_mix_size") <= F.col("_mix_fit")))
        took = _filled(around).groupBy("source").agg(F.sum(F.col("_mix_size") * F.col("_mix_taken")).alias("took"))
        joined = last.join(took.withColumnRenamed("source", "_mix_source"), F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
        left = joined.withColumns({"_mix_left": F.greatest(F.lit(0.0), F.col("_mix_left") - F.coalesce("took", F.lit(0))), "_mix_from": F.col("_mix_high")}).drop("took")
        left = left.where(F.col("_mix_left") > F.col("_mix_target") * REST).withColumns({"_mix_fit": F.floor("_mix_left"), "_mix_low": F.col("_mix_high"), "_mix_high": F.lit(1.0)})
        left = materialize(left.drop("_mix_docs", "_mix_same"), "mix-left")
        behind = _on_source(rows, left).where((F.col(_U) >= F.col("_mix_low")) & (F.col("_mix_size") <= F.col("_mix_fit")) & (F.col("_mix_size") > 0))
        fits = behind.groupBy(F.col("source").alias("_mix_source")).agg(F.count(F.lit(1)).alias("_mix_docs"))
        again = materialize(left.join(fits, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source"), "mix-again")
        if not again.limit(1).count():
            return rounds
        starts = again.select("source", "_mix_from")
        rounds.append(materialize(_on_source(_cut(rows, again.drop("_mix_from")), starts), "mix-round"))


def _filled(around: DataFrame) -> DataFrame:
    """source, _mix_u, _mix_size, _mix_n, _mix_taken: for each distinct row around a cut how many there are, and how many of them are taken
    one time more.  Rows that share u are one group with a count, so at most ``2 * NEAR`` groups of a source meet."""
    groups = around.groupBy("source", _U).agg(F.first("_mix_size").alias("_mix_size"), F.count(F.lit(1)).alias("_mix_n"), F.first("_mix_left").alias("_mix_left"))
    filled = groups.groupBy("source").applyInPandas(_fill, groups.withColumn("_mix_extra", F.lit(0).cast("long")).schema)
    return filled.select("source", _U, "_mix_size", "_mix_n", F.col("_mix_extra").alias("_mix_taken"))


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """In rank order, as many of each as still fit; then one more of what comes closest to the target."""
    left = float(group["_mix_left"].iloc[0])
    share = min(max(left / max(float((group["_mix_size"] * group["_mix_n"]).sum()), 1.0), 1e-12), 1 - 1e-12)
    rank = (group[_U] / (1 - group[_U])) / (share / (1 - share))
    group = group.loc[rank.sort_values(kind="stable").index].reset_index(drop=True)
    extra = [0] * len(group)
    for i, (size, n) in enumerate(zip(group["_mix_size"].tolist(), group["_mix_n"].tolist(), strict=True)):
        extra[i] = int(min(n, left // size)) if size else n
        left -= extra[i] * size
    closer = [(s, i) for i, (s, n) in enumerate(zip(group["_mix_size"].tolist(), group["_mix_n"].tolist(), strict=True)) if extra[i] < n and 0 < s < 2 * left]
    if closer:
        extra[min(closer, key=lambda x: abs(x[0] - left))[1]] += 1
    group["_mix_extra"] = extra
    return group


def _some_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of which, by source and u, ``_mix_n`` agree in everything and ``_mix_taken`` are to be taken: one of each is kept and written anew as often
    as there are, in chunks that are dealt out."""
    named = groups.select(F.col("source").alias("_mix_source"), F.col(_U).alias("_mix_v"), "_mix_n", "_mix_taken")
    own = [c for c in rows.columns if c not in ("source", _U)]
    one = rows.join(named, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col(_U) == F.col("_mix_v"))).groupBy("source", _U).agg(F.first(F.struct(*own)).alias("_row"), F.first("_mix_n").alias("_mix_n"), F.first("_mix_taken").alias("_mix_taken"))
    chunks = one.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_n") - 1, F.lit(CHUNK).cast("long"))))
    dealt = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", _U, "_at")
    every = dealt.withColumn("_i", F.explode(F.sequence("_at", F.least(F.col("_at") + CHUNK, F.col("_mix_n")) - 1)))
    return every.select(*[F.col(c) if c in ("source", _U) else F.col(f"_row.{c}").alias(c) for c in rows.columns], (F.col("_i") < F.col("_mix_taken")).cast("int").alias("_mix_extra"))


def mix_sized(rows: DataFrame) -> DataFrame:
    """The rows of :func:`sized` with ``_mix_words`` and ``_mix_target`` of their source, and ``_mix_copies`` (0, 1 or 2)."""
    sizes = materialize(rows.select("source", "_mix_size", _U), "mix-sizes")
    rounds = plan_mix(sizes)
    whole = rounds[0].select("source", "_mix_words", "_mix_target", "_mix_copies")
    # what each round says of rows around its cut, by distinct row
    told, sure = None, F.lit(False)
    for i, plan in enumerate(rounds):
        around = _on_source(sizes, plan).where((F.col(_U) >= F.col("_mix_low")) & (F.col(_U) < F.col("_mix_high")) & (F.col("_mix_size") <= F.col("_mix_fit")))
        own = _filled(around).select("source", _U, "_mix_n", "_mix_taken")
        told = own if told is None else told.unionByName(own)
    told = materialize(told.where("_mix_taken > 0"), "mix-told")
    planned = _on_source(rows, whole)
    for i, plan in enumerate(rounds):
        span = plan.select(F.col("source").alias("_mix_source"), *[F.col(c).alias(f"{c}_{i}") for c in ("_mix_from", "_mix_low", "_mix_fit")])
        planned = planned.join(span, F.col("source").eqNullSafe(F.col("_mix_source")), "inner" if i == 0 else "left").drop("_mix_source")
        sure = sure | F.coalesce((F.col(_U) >= F.col(f"_mix_from_{i}")) & (F.col(_U) < F.col(f"_mix_low_{i}")) & (F.col("_mix_size") <= F.col(f"_mix_fit_{i}")), F.lit(False))
    planned = planned.withColumn("_mix_sure", sure).drop(*[f"{c}_{i}" for i in range(len(rounds)) for c in ("_mix_from", "_mix_low", "_mix_fit")])
    named = told.select(F.col("source").alias("_mix_source"), F.col(_U).alias("_mix_v"), "_mix_n", "_mix_taken")
    marked = planned.join(named, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col(_U) == F.col("_mix_v")), "left").drop("_mix_source", "_mix_v")
    part = F.coalesce(F.col("_mix_taken") < F.col("_mix_n"), F.lit(False))  # only some of equal rows
    clear = marked.where(~part).withColumn("_mix_extra", (F.col("_mix_sure") | F.col("_mix_taken").isNotNull()).cast("int")).drop("_mix_n", "_mix_taken")
    split = materialize(told.where("_mix_taken < _mix_n"), "mix-split")
    decided = clear
    if split.limit(1).count():
        decided = clear.unionByName(_some_of(planned, split))
    return decided.withColumn("_mix_copies", (F.col("_mix_copies") + F.col("_mix_extra")).cast("int")).drop("_mix_extra", "_mix_sure", _U)


def mixed_rows(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix_sized(sized(docs, seed)).where("_mix_copies > 0")
    return mixed.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*docs.columns)


def mixture(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    mixed = mix_sized(sized(docs.select("doc_id", "text", "source"), seed).drop("text"))
    size: Column = F.col("_mix_size")
    return mixed.select("doc_id", size.alias("size"), F.col("_mix_words").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * size).alias("taken"))
