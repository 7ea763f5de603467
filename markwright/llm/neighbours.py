"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product is turned into least distance: every vector x gets one more component
``sqrt(M**2 - |x|**2)``, where M is the largest norm, and a query 0 there.  Vectors are projected to
``DIMS`` dimensions by a Gaussian (2-stable) matrix, so that for two points at distance r the squared
distance of their projections is ``r**2`` times a chi-square variable with DIMS degrees of freedom.

The index is a kd-tree on the projections.  Its upper part deals all vectors into cells of about ``CELL`` and is fitted in tiers of
``TIER`` levels, each on about ``SAMPLE`` vectors of every node that is split; its arrays take 16 bytes for each cell.  The lower part is
built in each cell, down to leaves of ``LEAF`` vectors with their bounding boxes.  A query looks at leaves whose boxes are near
its projection, takes their vectors in order of projected distance and verifies them by exact inner products, until the test holds: the next
one is farther than ``d_k * sqrt(q)``, where d_k is the distance of the k-th best so far and q the
chi-square quantile at ``SURE``.  A true neighbour is missed with probability at most ``1 - SURE``, and with less the nearer it is.

Round one searches a query's own cell, which bounds d_k; round two all other cells whose regions are
within the stopping radius.  So each pair of a query and a cell is handled once.  A cell that has got more than twice ``CELL`` vectors (projections
that hardly differ) is dealt into parts by a hash, so a task never holds more.
Equal vectors are collapsed before all that: at most k + 1 ids of each are kept, the smallest (no
query can return more), and a repeated query vector is searched once.

Defined results: vectors that are null, zero, of another than the commonest length, or hold null or
non-finite components take no part, nor do rows with a null id; of repeated ids each row counts; ties go
to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.sampling import under
from markwright.session import materialize

K = 20
EVERY = 20
DIMS = 24
SURE = 0.9
SAMPLE = 16_384
TIER = 8
CELL = 8_192
LEAF = 64


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 20.0 * dims
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def clean(table: DataFrame) -> DataFrame:
    """id, vec of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    own = own.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    most = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("vec") == (most["n"] if most else 0))


def distinct_vectors(own: DataFrame, k: int = K) -> DataFrame:
    """key, vec, ids: the k + 1 smallest ids of each distinct vector."""
    keyed = own.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))  # -0.0 becomes 0.0
    keyed = keyed.withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))).cast("binary"))))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= k + 1)
    return ranked.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))


def median_splits(points: np.ndarray, depth: int) -> list[tuple[int, int, float]]:
    """(node, axis, cut) of the nodes of ``depth`` levels, the root being node 1; each cut is the median on the axis of largest variance."""
    found, todo = [], [(1, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node >> depth or not len(rows):
            continue
        own = points[rows]
        axis = int(own.var(axis=0).argmax())
        cut = float(np.median(own[:, axis]))
        found.append((node, axis, cut))
        low = own[:, axis] < cut
        todo += [(2 * node, rows[low]), (2 * node + 1, rows[~low])]
    return found


class Splits:
    """The upper part of the kd-tree: an array-backed binary tree of ``2**depth`` cells."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.axis = np.zeros(1 << depth, np.int32)
        self.cut = np.zeros(1 << depth)

    def nodes(self, points: np.ndarray, levels: int) -> np.ndarray:
        """The node that each point reaches after so many levels."""
        node = np.ones(len(points), np.int64)
        for _ in range(levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node

    def cells(self, points: np.ndarray) -> np.ndarray:
        return self.nodes(points, self.depth) - (1 << self.depth)

    def near(self, point: np.ndarray, radius2: float) -> list[int]:
        """Cells whose region comes within the radius of the point."""
        out: list[int] = []
        todo = [(1, np.zeros(len(point)), 0.0)]
        while todo:
            node, off, far = todo.pop()
            if node >> self.depth:
                out.append(node - (1 << self.depth))
                continue
            axis, gap = self.axis[node], point[self.axis[node]] - self.cut[node]
            own = node * 2 + (gap >= 0)
            todo.append((own, off, far))
            other = far - off[axis] ** 2 + gap**2
            if other <= radius2:
                moved = off.copy()
                moved[axis] = abs(gap)
                todo.append((own ^ 1, moved, other))
        return out


class Cell:
    """The lower part of the tree for one cell's vectors."""

    def __init__(self, points: np.ndarray, projected: np.ndarray) -> None:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            axis = int(np.ptp(projected[rows], axis=0).argmax())
            half = np.argpartition(projected[rows, axis], len(rows) // 2)
            todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        self.leaves, self.points, self.projected = leaves, points, projected
        self.square = (projected * projected).sum(axis=1)
        self.low = np.array([projected[rows].min(axis=0) for rows in leaves])
        self.high = np.array([projected[rows].max(axis=0) for rows in leaves])

    def search(self, query: np.ndarray, projection: np.ndarray, square: float, worst: float, k: int, q: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, inner products, number of verified vectors) that may be among the k best; ``square`` is |query|**2 + M**2, so that the squared
        distance is ``square - 2 * product``; ``worst`` is a known lower bound of the k-th best product."""
        gap = np.maximum(np.maximum(self.low - projection, projection - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        rows, scores, verified, at = np.zeros(0, np.int64), np.zeros(0), 0, 0
        if worst == -math.inf:  # the nearest leaves give a first bound
            while at < len(order) and len(rows) < k:
                new = self.leaves[order[at]]
                rows, scores, at = np.concatenate([rows, new]), np.concatenate([scores, self.points[new] @ query]), at + 1
            verified = len(rows)
            if len(rows) < k:
                return rows, scores, verified
            worst = float(np.partition(scores, -k)[-k])
        rest = order[at:]
        rest = rest[far[rest] <= q * max(square - 2 * worst, 0.0)]
        if len(rest):
            some = np.concatenate([self.leaves[i] for i in rest])
            away = self.square[some] - 2 * (self.projected[some] @ projection) + projection @ projection
            inside = away <= q * max(square - 2 * worst, 0.0) * (1 + 1e-12) + 1e-9
            some, away = some[inside], away[inside]
            near = np.argsort(away, kind="stable")
            some, away = some[near], away[near]
            at, step = 0, 64
            while at < len(some) and away[at] <= q * max(square - 2 * worst, 0.0) * (1 + 1e-12) + 1e-9:
                new = some[at : at + step]
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.points[new] @ query])
                verified += len(new)
                if len(rows) >= k:
                    worst = max(worst, float(np.partition(scores, -k)[-k]))
                at, step = at + step, min(step * 2, 512)
        keep = scores >= worst
        return rows[keep], scores[keep], verified


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _tier(splits: Splits, project, done: int, step: int):
    """(place, split): which node a vector reaches after ``done`` levels, and the next ``step`` levels below a node."""

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                points = project(_stack(part["vec"]))
                yield pd.DataFrame({"node": splits.nodes(points, done), "point": list(points)})

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows["point"].to_numpy())
        found = median_splits(points[np.lexsort(points.T)], step)
        # node n of the subtree, of level v, is the node that lies v levels below ``key``
        level = [n.bit_length() - 1 for n, _, _ in found]
        names = [(int(key[0]) << v) + n - (1 << v) for v, (n, _, _) in zip(level, found, strict=True)]
        return pd.DataFrame({"node": names, "axis": [a for _, a, _ in found], "cut": [c for *_, c in found]})

    return place, split


def fit_splits(vectors: DataFrame, count: int, project) -> Splits:
    """The upper part of the tree for ``count`` rows (key, vec), tier by tier."""
    splits, done = Splits(max(0, math.ceil(math.log2(count / CELL)))), 0
    ranked = vectors.withColumn("rank", F.xxhash64("key", F.lit(3)))
    while done < splits.depth:
        step = min(TIER, splits.depth - done)
        place, split = _tier(splits, project, done, step)
        some = ranked.where(under(SAMPLE * (1 << done) / count)).mapInPandas(place, "node long, point array<double>")
        for r in some.groupBy("node").applyInPandas(split, "node long, axis int, cut double").collect():  # one row for each pair of cells
            splits.axis[r["node"]], splits.cut[r["node"]] = r["axis"], r["cut"]
        done += step
    return splits


def nearest(table: DataFrame, k: int = K, every: int = EVERY, sure: float = SURE, seed: int = 5, measure: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` (vec_id, embedding) whose id is divisible by ``every``.

    With ``measure`` there is a column ``verified`` too: how many distinct vectors the query was compared with exactly.
    """
    spark = table.sparkSession
    own = clean(table.select("vec_id", "embedding"))
    vectors = materialize(distinct_vectors(own, k), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, top, size = vectors.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vec"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double" + (", verified long" if measure else ""))
    largest = top * (1 + 1e-9)
    matrix = np.random.default_rng(seed).standard_normal((size + 1, DIMS))

    def project(vecs: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(largest - (vecs * vecs).sum(axis=1), 0))
        return vecs @ matrix[:-1] + rest[:, None] * matrix[-1]

    splits = fit_splits(vectors, count, project)
    q = chi_square_quantile(sure)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                part["cell"] = splits.cells(project(_stack(part["vec"])))
                yield part

    placed = materialize(vectors.mapInPandas(place, "key binary, vec array<float>, ids array<long>, cell long"), "cells")
    large = placed.groupBy("cell").count().where(F.col("count") > 2 * CELL).select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    parts_of = {r["cell"]: r["parts"] for r in large.collect()}  # cells that cuts could not divide, if any
    parts = F.lit(1)
    if parts_of:
        parts = F.coalesce(F.create_map(*[F.lit(x) for c, n in parts_of.items() for x in (c, n)])[F.col("cell")], F.lit(1))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    asked = own.where(F.pmod("id", F.lit(every)) == 0)
    asked = asked.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))
    asked = materialize(asked.select("id", F.unhex(F.md5(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))).cast("binary"))).alias("qkey")), "asked")
    queries = placed.join(asked.select(F.col("qkey").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("qkey"), F.col("vec").alias("qvec"), F.col("cell").alias("home"), F.col("part").alias("own"))
    queries = materialize(queries, "queries")

    def search(key: tuple, points: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(ask):
            points = points.sort_values("key", kind="stable")  # reruns build the same leaves
            vecs, ids = _stack(points["vec"]), points["ids"].tolist()
            cell = Cell(vecs, project(vecs))
            for qkey, qvec, worst in zip(ask["qkey"], _stack(ask["qvec"]), ask["worst"], strict=True):
                rows, scores, verified = cell.search(qvec, qvec @ matrix[:-1], float(qvec @ qvec) + largest, worst, k + 1, q)
                best = sorted((-float(vecs[r] @ qvec), i) for r in rows for i in ids[r])[: k + 1]
                out.append((qkey, [i for _, i in best], [-s for s, _ in best], verified))
        return pd.DataFrame(out, columns=["qkey", "ids", "scores", "verified"])

    found = "qkey binary, ids array<long>, scores array<double>, verified long"
    points = placed.select("cell", "part", "key", "vec", "ids")
    one = queries.select(F.col("home").alias("cell"), F.col("own").alias("part"), "qkey", "qvec", F.lit(float("-inf")).alias("worst"))
    first = materialize(points.groupBy("cell", "part").cogroup(one.groupBy("cell", "part")).applyInPandas(search, found), "round-one")

    def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for qkey, qvec, home, own, scores in zip(part["qkey"], part["qvec"], part["home"], part["own"], part["scores"], strict=True):
                vec = np.asarray(qvec, float)
                worst = scores[k] if scores is not None and len(scores) > k else -math.inf
                radius2 = q * max(float(vec @ vec) + largest - 2 * worst, 0.0)
                out += [(c, p, qkey, qvec, worst) for c in splits.near(vec @ matrix[:-1], radius2) for p in range(parts_of.get(c, 1)) if (c, p) != (home, own)]
            yield pd.DataFrame(out, columns=["cell", "part", "qkey", "qvec", "worst"])

    two = queries.join(first, "qkey", "left").select("qkey", "qvec", "home", "own", "scores").mapInPandas(others, "cell long, part int, qkey binary, qvec array<float>, worst double")
    second = points.groupBy("cell", "part").cogroup(two.groupBy("cell", "part")).applyInPandas(search, found)
    hits = first.unionByName(second)
    if measure:
        hits = materialize(hits, "hits")
    pairs = hits.select("qkey", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("qkey", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = best.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("hits"))
    if measure:
        lists = lists.join(hits.groupBy("qkey").agg(F.sum("verified").alias("verified")), "qkey")
    more = ["verified"] if measure else []
    answers = asked.join(lists, "qkey").select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("id")), 1, k).alias("hits"), *more)
    return answers.select("query_id", F.posexplode("hits").alias("rank", "hit"), *more).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"), *more)
