"""Benchmark decontamination with SimHash windows, multi-index Hamming search and exact verification.

An item is a benchmark text of n words.  A document is read in windows of each item size, one
starting at every word.  A window and an item of its size are compared by 128-bit SimHashes of their
five-word shingles, where the second, third, ... occurrence of a shingle counts as an element of its own; so the weighted
Jaccard similarity of two bags is that of two sets, and fingerprints at similarity 0.8 differ in some 19 bits, with a standard deviation of 4.

Multi-index search finds all fingerprints within ``RADIUS`` = 35 bits (four deviations more): of four blocks of 32 bits one at least differs
in 8 bits or less, and of its two halves of 16 bits either the first in 4 or less or the second in 3 or less.  Items are indexed
by half under all such values, so a lookup is exact; the block and then the whole fingerprint are tested before anything is verified.  For
fingerprints that have nothing in common the lookups reach a fifth of the items and the block test leaves about a hundredth.
Candidates are verified by the exact weighted Jaccard similarity of their shingles
(weights: numbers of occurrences), and match at 0.8 or more.

Fingerprints are only formed for windows that hold at least one shingle of some item: any other
window has similarity 0 with every item, so nothing is lost.  Of the windows of one size in a text that are the same bag, the first is searched.

Items are broadcast in blocks of ``ITEMS`` (a fixed bound); each block is one pass over the
documents.  Nothing is shuffled but the results of several blocks for one document.

Defined results: null texts, and texts or items without words, match nothing; an item of less than
five words is one shingle, found where exactly these words stand in a row; a document shorter than an item is one window;
repeated rows give repeated results; with an empty benchmark nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.hashing import SHINGLE, U64, HashIndex, batches, mix, shingle_hashes, token_hashes
from markwright.llm.sampling import bounded_batches

ITEMS = 2_000  # the index of an item takes some 51 kB
BITS = 128
BLOCKS = 4
HALVES = (4, 3)  # bits that the halves of a block may differ in; the block in their sum and 1 more
RADIUS = BLOCKS * (sum(HALVES) + 1) + BLOCKS - 1
THRESHOLD = 0.8
STEP = 1 << 14  # shingles worked on at once
PAIRS = 1 << 17  # lookups held at once


def _bits(elements: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` values, 1 or -1, for each element."""
    wide = np.stack([elements, mix(elements ^ U64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1)


def _pack(signs: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of two 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def numbered(bag: np.ndarray) -> np.ndarray:
    """The elements of a bag: a shingle's first occurrence is the shingle itself, later ones are told apart."""
    order = np.argsort(bag, kind="stable")
    own = bag[order]
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    nth = np.arange(len(own)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return np.where(nth > 0, mix(own ^ mix(nth.astype(U64))), own)


def simhash(bag: np.ndarray) -> np.ndarray:
    return _pack((_bits(numbered(bag)).sum(axis=0, dtype=np.int64) > 0)[None, :])[0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags given as arrays with repetitions."""
    (ka, ca), (kb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.minimum(ca[i], cb[j]).sum()
    return float(shared / (len(a) + len(b) - shared))


@cache
def _within(bits: int) -> np.ndarray:
    """The 16-bit values with at most so many bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class HammingIndex:
    """Fingerprints by half block, under all values that a near fingerprint may have there.  The values are kept sorted, so
    the index takes memory for its items only, however few of them share a length."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = np.ascontiguousarray(prints, "<u8").reshape(-1, 2)
        halves, kind = self.prints.view("<u2"), np.uint16 if len(self.prints) < 1 << 16 else np.int32
        self.values, self.items = [], []
        for half in range(2 * BLOCKS):
            near = _within(HALVES[half % 2])
            value = (halves[:, half][:, None] ^ near[None, :]).ravel()
            order = np.argsort(value, kind="stable")
            self.items.append((order // len(near)).astype(kind))
            self.values.append(value[order])
        self.looked = self.tested = 0  # pairs that lookups gave, and pairs that the block test left

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) for all pairs at most RADIUS apart, each once."""
        prints = np.ascontiguousarray(prints, "<u8").reshape(-1, 2)
        halves, blocks, own = prints.view("<u2"), prints.view("<u4"), self.prints.view("<u4")
        found = [np.zeros(0, np.int64)]
        for half in range(2 * BLOCKS):
            start = np.searchsorted(self.values[half], halves[:, half], "left")
            size = np.searchsorted(self.values[half], halves[:, half], "right") - start
            upto = np.cumsum(size)
            cuts = [0, *np.flatnonzero(np.diff(upto // PAIRS)) + 1, len(prints)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = size[a:b]
                query = np.repeat(np.arange(a, b), some)
                at = np.arange(len(query)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(start[a:b], some)
                item = self.items[half][at].astype(np.int64)
                self.looked += len(query)
                near = np.bitwise_count(blocks[query, half // 2] ^ own[item, half // 2]) <= sum(HALVES) + 1
                query, item = query[near], item[near]
                self.tested += len(query)
                near = np.bitwise_count(prints[query] ^ self.prints[item]).sum(axis=1) <= RADIUS
                found.append(query[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.prints), 1), pairs % max(len(self.prints), 1)


class Benchmark:
    """Items prepared for search."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        words, at = token_hashes([t for _, t in items])
        self.bags: list[np.ndarray] = []
        self.ids: list[int] = []
        by_size: dict[int, list[int]] = {}
        for i, (item_id, _) in enumerate(items):
            own = words[at[i] : at[i + 1]]
            if len(own):
                by_size.setdefault(len(own), []).append(len(self.bags))
                self.ids.append(item_id)
                self.bags.append(shingle_hashes(own, np.array([0, len(own)]))[0])
        self.sizes = {n: (np.array(own), HammingIndex(np.stack([simhash(self.bags[i]) for i in own]))) for n, own in sorted(by_size.items())}
        self.index = HashIndex(np.unique(np.concatenate(self.bags)) if self.bags else np.zeros(0, U64))
        self.short = [n for n in self.sizes if n < SHINGLE]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(text, item_id, similarity, first word, end word): the best window of each item that a text holds."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not self.bags:
            return []
        words, offsets = token_hashes(texts)
        for width in [*self.short, SHINGLE]:
            runs, at = shingle_hashes(words, offsets, width)
            hit = self.index.find(runs) >= 0
            rows = np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1)
            sizes = {n: x for n, x in self.sizes.items() if (n == width if width < SHINGLE else n >= SHINGLE)}
            if len(rows) and sizes:
                self._search(rows, runs, at, hit, np.diff(offsets), sizes, width, best)
        return [(row, self.ids[item], *found) for (row, item), found in sorted(best.items())]

    def _search(self, rows, runs, at, hit, n_words, sizes, width, best) -> None:
        counts = np.diff(at)[rows]
        own = np.repeat(np.arange(len(rows)), counts)
        start = np.cumsum(counts) - counts
        pick = np.arange(counts.sum()) - np.repeat(start, counts) + np.repeat(at[rows], counts)
        runs, hit = runs[pick], hit[pick]
        hits = np.concatenate([[0], np.cumsum(hit)])
        bags = np.concatenate([np.zeros(1, U64), np.cumsum(mix(runs ^ U64(0xA24BAED4963EE407)), dtype=U64)])  # the same difference: the same bag
        ends = (start + counts)[own]
        again = self._next_same(runs, own)
        for c in range(0, len(runs), STEP):
            longest = max(n - width + 1 for n in sizes)
            last = min(c + STEP, len(runs))
            if hits[min(last + longest, len(runs))] == hits[c]:
                continue
            piece = runs[c : last + longest]
            sums = np.zeros((len(piece) + 1, BITS), np.int16 if longest < 1 << 15 else np.int32)  # differences are right modulo 2**16
            np.cumsum(_bits(piece), axis=0, dtype=sums.dtype, out=sums[1:])
            place = np.arange(c, last)
            for n, (items, index) in sizes.items():
                span = n - width + 1  # shingles of a window
                end = np.minimum(place + span, ends[place])
                full = (end - place == span) | ((place == start[own[place]]) & (counts[own[place]] < span))
                window = np.flatnonzero(full & (hits[end] > hits[place]))
                if not len(window):
                    continue
                bag = np.stack([own[place[window]].astype(U64), bags[end[window]] - bags[place[window]]], axis=1)
                window = window[np.sort(np.unique(bag, axis=0, return_index=True)[1])]
                a, e = place[window], end[window]
                prints = _pack(sums[e - c] - sums[a - c] > 0)
                for i in np.flatnonzero(again[a] < e):  # a shingle occurs twice in the window
                    prints[i] = simhash(runs[a[i] : e[i]])
                for q, i in zip(*index.search(prints), strict=True):
                    similarity = weighted_jaccard(runs[a[q] : e[q]], self.bags[items[i]])
                    if similarity >= self.threshold:
                        row, first = int(rows[own[a[q]]]), int(a[q] - start[own[a[q]]])
                        found = (similarity, first, min(first + n, int(n_words[row])))
                        key = (row, int(items[i]))
                        if key not in best or similarity > best[key][0]:
                            best[key] = found

    @staticmethod
    def _next_same(runs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each place the least place from there on at which a shingle of the same text, from there on too, stands again."""
        order = np.lexsort((np.arange(len(runs)), runs, own))
        after = np.full(len(runs), len(runs) + 1)
        same = (runs[order[1:]] == runs[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
        after[order[:-1][same]] = order[1:][same]
        return np.minimum.accumulate(after[::-1])[::-1]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``ITEMS``, each small enough to broadcast."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    blocks = -(-items.count() // ITEMS)
    for k in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word for each item that a document holds."""
    bounded_batches(docs.sparkSession)
    found = None
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value, threshold)
            for part in parts:
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                out = [(ids[a + r], *rest) for a, b in batches(texts, 1 << 20) for r, *rest in bench.matches(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        own = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, end_word long")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("end_word")).where("false")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; one pass over the rows for each block of items."""
    bounded_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value, threshold)
            for part in parts:
                texts = part.column("text").to_pylist()
                keep = np.ones(len(texts), bool)
                for a, b in batches(texts, 1 << 20):
                    keep[[a + m[0] for m in bench.matches(texts[a:b])]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
