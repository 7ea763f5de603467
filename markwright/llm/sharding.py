"""Sharding by histogram sort.

Documents are ordered by a hash of their text, so equal texts lie side by side, and splitters between shards are found
without moving rows: every round counts, on all partitions, the exact bytes between candidate key boundaries (256
probes inside each interval that still holds a splitter), and keeps the sub-interval that holds the target.  A
splitter is settled once a probe is within the tolerance of its target; otherwise its interval is probed 8 bits finer.
The rows are then exchanged once.

Groups of equal texts stay whole.  Those of at least ``HEAVY`` of a shard's bytes (at most ``shards / HEAVY``, found by
the same counting) would make a shard too large or too small wherever a splitter falls, so they are placed first, each
on the emptiest shard; splitters then divide the light rows by what is left of each shard, between groups only.  A group that is
larger than a shard cannot stay whole: it is cut by a hash of doc_id and of the row's place in the written table, so that
rows that agree in everything are dealt out too.

What the driver sees is bounded by the number of shards (at most 256 counts for each open splitter, and the groups above),
whatever the number of rows.

Defined results: a null text has size 16 and the key of an empty text; rows with a null doc_id are
placed like others; repeated rows are separate rows; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` do not matter to :func:`shard_documents` and are kept by :func:`write_shards`.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.session import materialize

OVERHEAD = 16
DIGITS = 8  # digits of 8 bits in a key
HEAVY = 0.01  # of a shard
PART_ROWS = 500_000  # rows of a shard that one task numbers
FILE_BYTES = 256 << 20  # of a shard that one task writes
LIGHT, WHOLE = -1, -2  # kinds of rows; others are numbers of groups that are cut


def _unsigned(column: Column) -> Column:
    """A signed number whose bits, read as unsigned, are in the order of the signed ones."""
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(column: Column, digits: int) -> Column:
    """The first digits of a key as a number; ``digits`` is less than 8."""
    return F.shiftrightunsigned(_unsigned(column), 64 - 8 * digits) if digits else F.lit(0).cast("long")


def _with_keys(docs: DataFrame) -> DataFrame:
    """``_k1`` from the text, ``_k2`` from doc_id and the row's place."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.withColumns({"_k1": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "_k2": F.xxhash64(doc, F.monotonically_increasing_id())})


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD


def _keyed(docs: DataFrame) -> DataFrame:
    docs = _with_keys(docs.select("doc_id", "text"))
    return docs.select("doc_id", _size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "_k1", "_k2")


def heavy_groups(keyed: DataFrame, least: float) -> dict[int, int]:
    """Bytes by key of the groups of at least ``least`` bytes: 16 bits of the key are counted at a time, below the intervals that are heavy."""
    alive: list[int] | None = None
    found: dict[int, int] = {}
    for digits in (2, 4, 6, 8):
        rows = keyed if alive is None else keyed.where(_prefix(F.col("_k1"), digits - 2).isin(alive))
        at = _prefix(F.col("_k1"), digits) if digits < DIGITS else F.col("_k1")
        found = {r["at"]: r["bytes"] for r in rows.groupBy(at.alias("at")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= least).collect()}
        alive = list(found)
        if not alive:
            break
    return found


def find_splitters(rows: DataFrame, goals: dict[int, list[float]], tolerance: float, atomic: set[int]) -> dict[int, list[int]]:
    """For each kind of rows (``_kind``, ``_key``, ``size``) the keys at which its running bytes pass the goals.

    Rows below the first key come before the first goal, and so on; goals are absolute bytes in ascending order and are met to
    ``tolerance`` bytes or, on the finest level, to the bytes of one key.  In kinds of ``atomic`` that is one group.
    """
    settled: dict[tuple[int, int], int] = {}
    open_ = {(kind, 0): (0.0, list(range(len(own)))) for kind, own in goals.items() if own}  # (kind, prefix): bytes below it, goals in it
    for level in range(DIGITS):
        if not open_:
            break
        inside = F.struct("_kind", _prefix(F.col("_key"), level).alias("p")).isin([F.struct(F.lit(k).alias("_kind"), F.lit(p).cast("long").alias("p")) for k, p in open_])
        digit = F.shiftrightunsigned(_unsigned(F.col("_key")), 56 - 8 * level).bitwiseAND(F.lit(255)).cast("int")
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for r in rows.where(inside).groupBy("_kind", _prefix(F.col("_key"), level).alias("p"), digit.alias("d")).agg(F.sum("size").alias("bytes")).collect():
            counts.setdefault((r["_kind"], r["p"]), {})[r["d"]] = r["bytes"]
        deeper: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for (kind, prefix), (below, mine) in open_.items():
            edges, digits = [below], sorted(counts.get((kind, prefix), {}))
            for d in digits:
                edges.append(edges[-1] + counts[kind, prefix][d])
            for g in mine:
                goal = goals[kind][g]
                i = max(1, min(bisect.bisect_left(edges, goal), len(digits)))
                near = min((i - 1, i), key=lambda e: abs(edges[e] - goal))
                if not digits or abs(edges[near] - goal) <= tolerance or level == DIGITS - 1:
                    after = (prefix << 8 | digits[near]) if near < len(digits) else (prefix << 8 | (digits[-1] + 1 if digits else 0))
                    settled[kind, g] = after << 8 * (DIGITS - 1 - level)
                else:
                    deeper.setdefault((kind, prefix << 8 | digits[i - 1]), (edges[i - 1], []))[1].append(g)
        open_ = deeper
    return {kind: [settled[kind, g] for g in range(len(own))] for kind, own in goals.items()}


def _signed(key: int) -> int:
    """From the unsigned order back to the signed one; a key past the last is the last."""
    return min(key, (1 << 64) - 1) - (1 << 63)


class Plan:
    """Which shard a row belongs to, as a handful of literals: groups placed whole, and splitters by kind of rows."""

    def __init__(self, keyed: DataFrame, shards: int, tolerance: float) -> None:
        self.total = keyed.agg(F.sum("size")).first()[0] or 0
        share = self.total / shards
        groups = heavy_groups(keyed, HEAVY * share) if self.total else {}
        free = [(0.0, s) for s in range(shards)]  # bytes placed, shard
        self.whole: dict[int, int] = {}
        self.cut: list[int] = []
        pieces: dict[int, list[tuple[int, float]]] = {}  # of groups that are cut: (shard, bytes) in order
        for key, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
            if size > share:
                self.cut.append(key)
                own, left = pieces.setdefault(len(self.cut) - 1, []), float(size)
                while left > 0:
                    used, s = heapq.heappop(free)
                    part = min(left, max(share - used, 0.0)) or left
                    own.append((s, part))
                    left -= part
                    heapq.heappush(free, (used + part, s))
            else:
                used, s = heapq.heappop(free)
                self.whole[key] = s
                heapq.heappush(free, (used + size, s))
        used = dict((s, u) for u, s in free)
        room = [max(share - used[s], 0.0) for s in range(shards)]
        light = self.total - sum(groups.values())
        scale = light / sum(room) if sum(room) else 0.0
        order = {LIGHT: [(s, room[s] * scale) for s in range(shards) if room[s] > 0] or [(0, float(light))], **pieces}
        goals: dict[int, list[float]] = {}
        for kind, own in order.items():
            upto, goals[kind] = 0.0, []
            for _, size in own[:-1]:
                upto += size
                goals[kind].append(upto)
        found = find_splitters(self.kinds(keyed), goals, tolerance * share, {LIGHT}) if self.total else {k: [] for k in goals}
        self.points = sorted((kind, _signed(key), own[i][0]) for kind, own in order.items() for i, key in enumerate([0, *found[kind]]))

    def kinds(self, rows: DataFrame) -> DataFrame:
        """Adds ``_kind`` and ``_key``; the maps have at most ``shards / HEAVY`` entries."""
        kind = F.lit(LIGHT)
        if self.whole:
            kind = F.when(F.col("_k1").isin(list(self.whole)), F.lit(WHOLE)).otherwise(kind)
        for number, key in enumerate(self.cut):
            kind = F.when(F.col("_k1") == F.lit(key), F.lit(number)).otherwise(kind)
        own = rows.withColumn("_kind", kind.cast("int"))
        return own.withColumn("_key", F.when(F.col("_kind") >= 0, F.col("_k2")).otherwise(F.col("_k1")))

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds ``shard``."""
        own = self.kinds(rows)
        if not self.points:
            return own.withColumn("shard", F.lit(0)).drop("_kind", "_key")
        points = F.array(*[F.struct(F.lit(k).cast("int").alias("a"), F.lit(key).cast("long").alias("b")) for k, key, _ in self.points])
        here = F.struct(F.col("_kind").alias("a"), F.col("_key").alias("b"))
        shard = F.element_at(F.array(*[F.lit(s) for _, _, s in self.points]), F.greatest(F.size(F.filter(points, lambda p: p <= here)), F.lit(1)))
        if self.whole:
            table = F.create_map(*[F.lit(x) for key, s in self.whole.items() for x in (key, s)])
            shard = F.when(F.col("_kind") == WHOLE, table[F.col("_k1")]).otherwise(shard)
        return own.withColumn("shard", shard.cast("int")).drop("_kind", "_key")


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Law ``bytes``: shard sizes differ by the tolerance (a share of a shard's size) or by the group of equal texts at a
    boundary, which has less than ``HEAVY`` of a shard, whichever is more.  ``slot`` counts from 0 without gaps in each shard.
    """
    keyed = materialize(_keyed(docs), "shard-keys")
    plan = Plan(keyed, shards, tolerance)
    return _slots(plan.place(keyed), max(1, -(-keyed.count() // (shards * PART_ROWS // 2))))


def _slots(placed: DataFrame, parts: int) -> DataFrame:
    """Gapless positions without gathering a shard in one task: each shard is dealt into ``parts``
    by a hash of the row, positions are counted within a part and moved by the parts before it."""
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_k2"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "_part").count()
    ahead = counts.withColumn("_ahead", F.expr("sum(count) over (partition by shard order by _part) - count")).drop("count")
    within = placed.withColumn("_at", F.expr("row_number() over (partition by shard, _part order by _k1, _k2, doc_id) - 1"))
    return within.join(F.broadcast(ahead), ["shard", "_part"]).select(  # shards x parts rows: one for some 250,000 documents
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") + F.col("_ahead")).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.002) -> None:
    """Write the documents themselves, one folder for each shard, after a single exchange.

    A shard is written by as many tasks as it has ``FILE_BYTES``.  A group that is cut is dealt out anew as rows are read here, so its pieces
    have their sizes to within chance.
    """
    plan = Plan(materialize(_keyed(docs), "shard-keys"), shards, tolerance)
    files = max(1, -(-plan.total // (shards * FILE_BYTES)))
    moved = plan.place(_with_keys(docs)).withColumn("_file", F.pmod(F.xxhash64("_k2"), F.lit(files))).drop("_k1")
    ranged = moved.repartitionByRange(shards * files, "shard", "_file").drop("_k2", "_file")
    ranged.write.partitionBy("shard").parquet(path)
