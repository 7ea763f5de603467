"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

Every text is a bag of five-word shingles weighted by ``1 + log2(count)``.  Its signature comes from
exponential arrivals: each shingle emits a Poisson process whose rate is its weight, each arrival falls on a
random one of ``BANDS * ROWS`` components, and a component keeps the shingle that arrives first.
Two signatures agree in a component with the probability Jaccard similarity of the bags.  A
shingle stops once its next arrival is later than the latest component's first (early termination).
A text that repeats a shingle has a second signature, of the same shingles with weight 1, whose components agree
with the plain Jaccard similarity; for all other texts the two are the same.

Equal texts are collapsed first.  Texts that share a hash of a band of either signature meet in a bucket.  All pairs of a
bucket are never listed: a text is first verified against the least doc_id it meets.  Then, in buckets that
still hold several groups, the texts outside the bucket's largest group are compared with all others by
their signatures: both sides travel as packed blocks of about ``PACK`` texts, and a pair is listed only once, in the bucket
of the least hash it shares, and only if its texts are of different groups and the weighted or the plain signatures agree in
``ESTIMATE`` of the components or more.  At similarity 0.8, of either kind, they do with probability 0.9996; the listed pairs are verified exactly.

Two texts are linked if their probability Jaccard similarity, or the plain Jaccard similarity of their shingle
sets, computed exactly from the shingles, is at least the threshold.  Groups are the connected components of the links,
labelled by their least doc_id; labels spread by joins with pointer jumping, on the executors.

Defined results: a text of one to four words has one shingle; empty texts and texts without words
are only grouped with equal texts; a null text is a group of its own; rows with one doc_id are one document; a row
with a null doc_id gets the class of its text if another row gives it one, else null; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.hashing import U64, batches, mix, shingle_hashes, token_hashes
from markwright.llm.sampling import bounded_batches
from markwright.session import materialize, release

BANDS, ROWS = 32, 7
THRESHOLD = 0.8
ESTIMATE = 0.71
PACK = 512
BROADCAST_IDS = 300_000


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, offsets): each text's distinct shingles in order of hash."""
    words, at = token_hashes(texts)
    shingles, at = shingle_hashes(words, at)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((shingles, rows))
    s, r = shingles[order], rows[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(first)
    counts = np.diff(np.append(start, len(s)))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(r[start], minlength=len(texts)), out=offsets[1:])
    return s[start], 1 + np.log2(counts), offsets


def signatures(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``size`` shingle hashes for each text; 0 throughout for a text without shingles."""
    texts = len(offsets) - 1
    first = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, U64)
    row = np.repeat(np.arange(texts), np.diff(offsets))
    shingle, rate, state = shingles, 1 / weights, shingles
    time = np.zeros(len(shingles))
    while len(row):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-((state >> U64(11)).astype(float) * 2.0**-53)) * rate
        spot = row * size + (mix(state ^ U64(0x5851F42D4C957F2D)) % U64(size)).astype(np.int64)
        np.minimum.at(first, spot, time)
        won = first[spot] == time
        winner[spot[won]] = shingle[won]
        go = time < first.reshape(texts, size).max(axis=1)[row]
        row, shingle, rate, state, time = row[go], shingle[go], rate[go], state[go], time[go]
    return winner.reshape(texts, size)


def plain_signatures(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that repeat a shingle, and their signatures with all weights 1."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    repeats = np.bincount(row, weights > 1, len(offsets) - 1) > 0
    own, sizes = shingles[repeats[row]], np.diff(offsets)[repeats]
    return np.flatnonzero(repeats), signatures(own, np.ones(len(own)), np.concatenate([[0], np.cumsum(sizes)]))


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), bands.shape[:2]).copy()
    for i in range(ROWS):
        total = mix(total * U64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return total.astype(np.int64)


def _bands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, bands (of both signatures); null bands for texts without words.  Copies within a batch are worked out once."""
    for part in parts:
        keys, texts = part.column("key").to_pylist(), part.column("text").to_pylist()
        place: dict[bytes, int] = {}
        for i, key in enumerate(keys):
            place.setdefault(key, i)
        once = list(place.values())
        bands: list[np.ndarray | None] = [None] * len(texts)
        for a, b in batches([texts[i] for i in once], 1 << 19):
            own = [texts[i] for i in once[a:b]]
            shingles, weights, at = weighted_shingles(own)
            for i, h, n in zip(once[a:b], band_hashes(signatures(shingles, weights, at)), np.diff(at), strict=True):
                bands[i] = h if n else None
            repeats, plain = plain_signatures(shingles, weights, at)
            for i, h in zip(repeats.tolist(), band_hashes(plain), strict=True):
                bands[once[a + i]] = np.concatenate([bands[once[a + i]], h])
        found = pa.array([bands[place[k]] for k in keys], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), found], names=["doc_id", "key", "bands"])


def _shingle_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, shingles, weights (empty if all are 1), marks: a byte for each component of the signature and the bands' hashes,
    then the same of the plain signature if it differs."""
    for part in parts:
        texts = part.column("text").to_pylist()
        columns: list[list[bytes]] = [[], [], []]
        for a, b in batches(texts, 1 << 19):
            s, w, at = weighted_shingles(texts[a:b])
            signature = signatures(s, w, at)
            own, bands = mix(signature).astype(np.uint8), band_hashes(signature).astype("<i8")
            for i in range(b - a):
                some = w[at[i] : at[i + 1]]
                columns[0].append(s[at[i] : at[i + 1]].astype("<u8").tobytes())
                columns[1].append(b"" if some.max(initial=1) == 1 else some.astype("<f4").tobytes())
                columns[2].append(own[i].tobytes() + bands[i].tobytes())
            repeats, plain = plain_signatures(s, w, at)
            own, bands = mix(plain).astype(np.uint8), band_hashes(plain).astype("<i8")
            for k, i in enumerate(repeats.tolist()):
                columns[2][i - (b - a)] += own[k].tobytes() + bands[k].tobytes()
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "shingles", "weights", "marks"])


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted sets with sorted elements.

    For a shared element d the term is ``1 / sum over e of max(wa(e) / wa(d), wb(e) / wb(d))``; with elements
    ordered by the ratio of their weights the sums are prefix and suffix sums.
    """
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if wa.max() == 1 and wb.max() == 1:
        return plain, plain
    x, y = wa[i], wb[j]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # max(x_e / x_d, y_e / y_d) is x_e / x_d where ratio_e >= ratio_d and y_e / y_d elsewhere.
    above = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())
    below = np.concatenate([[0.0], np.cumsum(y)[:-1]]) + (wb.sum() - y.sum())
    return float(np.sum(1 / (above / x + below / y))), plain


def _views(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The values of a binary column as arrays that share its memory."""
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return [np.frombuffer(data, kind, (b - a) // size, a) if b > a else np.zeros(0, kind) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _similar(threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = np.zeros(part.num_rows, bool)
            columns = [_views(part.column(name), kind) for name, kind in (("sa", "<u8"), ("wa", "<f4"), ("sb", "<u8"), ("wb", "<f4"))]
            for r, (a, wa, b, wb) in enumerate(zip(*columns, strict=True)):
                if min(len(a), len(b)) and (len(wa) or len(wb) or min(len(a), len(b)) >= threshold * max(len(a), len(b))):
                    xa = wa.astype(float) if len(wa) else np.ones(len(a))
                    xb = wb.astype(float) if len(wb) else np.ones(len(b))
                    keep[r] = max(probability_jaccard(a, xa, b, xb)) >= threshold
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that reach the threshold.  Both joins are plain equi-joins, whose skewed keys Spark splits."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    both = pairs.join(right, "b").join(left, "a")
    return both.mapInArrow(_similar(threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component, for every node of an edge (a, b)."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(seen, "node").select("node", F.least("label", "m").alias("next"), "label")
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next")
        new = materialize(jump.select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "cc-labels")
        release(labels)
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            release(both)
            return labels


def _merge(groups: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Groups after more links; ``groups`` maps nodes to labels."""
    if groups is None:
        return components(edges)
    a = groups.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = groups.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = components(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = groups.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct().join(groups.select("node"), "node", "left_anti"))
    return materialize(every.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "groups")


def text_key(docs: DataFrame):
    return F.unhex(F.md5(F.encode("text", "UTF-8")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text").withColumn("key", text_key(docs))
    found = materialize(keyed.where(F.col("text").isNotNull()).mapInArrow(_bands, "doc_id long, key binary, bands array<long>"), "bands")
    texts = found.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    reps = materialize(texts, "texts")
    spread = reps.where(F.col("bands").isNotNull() & F.col("rep").isNotNull()).select(F.col("rep").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    members = materialize(spread.join(shared.select("bucket", "least"), "bucket"), "buckets")
    groups = _grouped(docs, members, threshold)
    by_text = reps.select("key", "rep")
    if groups is not None:
        by_text = by_text.join(groups.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", F.coalesce("label", "rep").alias("class_id"))
    else:
        by_text = by_text.withColumnRenamed("rep", "class_id")
    placed = found.select("doc_id", "key").join(by_text, "key").select("doc_id", "class_id")
    return placed.unionByName(docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def _alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for the pairs of two blocks of a bucket that are worth verifying."""
    size = BANDS * ROWS

    def unpack(block: list[dict]) -> tuple[np.ndarray, ...]:
        whole = 2 * (size + 8 * BANDS)
        marks = np.frombuffer(b"".join(x["marks"] if len(x["marks"]) == whole else x["marks"] * 2 for x in block), np.uint8).reshape(len(block), 2, -1)
        repeats = np.array([len(x["marks"]) == whole for x in block])
        return np.array([x["doc"] for x in block]), np.array([x["label"] for x in block]), repeats, marks[:, :, :size], marks[:, :, size:].copy().view("<i8")

    for part in parts:
        found: list[tuple[int, int]] = []
        for bucket, out, every in zip(*(part.column(c) for c in ("bucket", "out", "every")), strict=True):
            key, others = bucket.as_py(), every.as_py()
            ids, labels, repeats, signs, bands = unpack(others)
            outside = np.array([x["outside"] for x in others])
            for doc, label, repeat, sign, band in zip(*unpack(out.as_py()), strict=True):
                todo = np.flatnonzero((labels != label) & ~(outside & (ids < doc)))  # of two outsiders the lesser looks
                close = (signs[todo, 0] == sign[0]).sum(axis=1) >= ESTIMATE * size
                more = np.flatnonzero(~close & (repeats[todo] | repeat))
                close[more] = (signs[todo[more], 1] == sign[1]).sum(axis=1) >= ESTIMATE * size
                near = todo[close]
                # either signature of one text may meet either of the other
                shared = np.concatenate([np.where(bands[near, i] == band[j], band[j], np.iinfo(np.int64).max) for i in (0, 1) for j in (0, 1)], axis=1)
                found += [(min(doc, x), max(doc, x)) for x in ids[near[shared.min(axis=1) == key]].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _unsettled(members: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups that share a bucket and have similar signatures."""
    named = members.select("bucket", "doc").join(groups.select(F.col("node").alias("doc"), "label"), "doc", "left").select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    held = named.groupBy("bucket", "label").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("groups"), F.max_by("label", F.struct("count", "label")).alias("main"))
    open_ = named.join(held.where("groups > 1"), "bucket").join(sets.select(F.col("doc_id").alias("doc"), "marks"), "doc")
    open_ = open_.withColumns({"outside": F.col("label") != F.col("main"), "block": F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / PACK)).cast("int")})
    packed = F.collect_list(F.struct("doc", "label", "outside", "marks"))
    out = open_.where("outside").groupBy("bucket", "block").agg(packed.alias("out")).drop("block")
    every = open_.groupBy("bucket", "block").agg(packed.alias("every")).drop("block")
    return out.join(every, "bucket").mapInArrow(_alike, "a long, b long")


def _grouped(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame | None:
    ids = members.select(F.col("doc").alias("doc_id")).distinct()
    count = ids.count()
    if not count:
        return None
    some = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = materialize(some.mapInArrow(_shingle_sets, "doc_id long, shingles binary, weights binary, marks binary"), "shingles")
    pairs = members.where("doc <> least").groupBy(F.col("doc").alias("b")).agg(F.min("least").alias("a"))
    groups = _merge(None, materialize(verified(pairs, sets, threshold).distinct(), "links"))
    rest = materialize(_unsettled(members, groups, sets), "unsettled")
    links = materialize(verified(rest, sets, threshold).distinct(), "links")
    return _merge(groups, links) if links.limit(1).count() else groups


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group, the one with its least doc_id.

    Of repeated rows with that doc_id one stays.  Rows with a null doc_id go if a row with a doc_id
    holds the same text, else they stay.
    """
    classes = materialize(near_duplicates(docs, threshold).where(F.col("doc_id").isNotNull()), "classes")
    gone = classes.where("class_id <> doc_id").select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    repeated = classes.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    nameless = docs.where(F.col("doc_id").isNull())
    if nameless.limit(1).count():
        held = docs.where(F.col("doc_id").isNotNull()).select(text_key(docs).alias("_key"))
        kept = kept.unionByName(nameless.withColumn("_key", text_key(docs)).join(held, "_key", "left_anti").drop("_key"))
    return kept.select(*docs.columns)
