"""Language identification by words first, then shorter and shorter character n-grams.

Training counts words (maximal runs of letters, in lower case) and the character n-grams of words,
by language, on the executors.  A word of the model scores by its log frequency in each language.
A word that the model lacks scores by its n-grams of the greatest length at which the model knows one of them: ``MAX_N``
characters first, then one less, down to single letters.  Words carry a boundary mark at both
ends for n-grams of two or more.  A text's language has the highest sum over its words; the score is its
share after a softmax of the sums.

Bounds: counts are taken over about ``max_rows`` training rows, picked by a hash of doc_id with an equal quota for each language (a language with
fewer rows keeps them all).  All words and n-grams of these rows are in the model, so its size is that of
the sample whatever the input; it keeps only the counts that are not 0.  Prediction covers every whole text.

Defined results: a null text, one without a letter, and any text when nothing could be learned give
``und`` with score 0; rows with a null doc_id count as a doc_id of null that never teaches; ties between languages
go to the first in order of code points; repeated rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.hashing import U64, HashIndex, batches, mix
from markwright.llm.sampling import bounded_batches, stratified_sample
from markwright.session import materialize

MAX_ROWS = 20_000
MAX_N = 4
BLOCK = 1 << 18  # characters hashed at once
_MARK = 0x1F  # stands for both ends of a word


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


_Q = 0x9FB21C651E98DF25
_QI = pow(_Q, -1, 1 << 64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _Q, U64), np.full(size, _QI, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a block of texts: spans in one code point array, and prefix sums for hashing."""

    def __init__(self, texts: list[str | None]) -> None:
        codes = [_code(t) if t else np.zeros(0, np.uint32) for t in texts]
        gap = np.zeros(1, np.uint32)
        self.code = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
        ends = np.cumsum([len(c) + 1 for c in codes])
        letter = np.zeros(len(self.code) + 2, bool)
        letter[1:-1] = _letters()[self.code]
        step = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = step[::2], step[1::2]
        self.row = np.searchsorted(ends, self.start, "right")
        power, self.inverse = _powers(1 << max(BLOCK.bit_length(), len(self.code).bit_length()))
        self.total = np.zeros(len(self.code) + 1, U64)
        np.cumsum((mix(self.code.astype(U64) + U64(1))) * power[: len(self.code)], out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into ``which``) of the n-grams of these words.  Of an n-gram that takes in a boundary mark the
        mark itself is left out of the span and told apart by a constant."""
        start, end = self.start[which], self.end[which]
        if n == 1:
            size = end - start
            own = np.repeat(np.arange(len(which)), size)
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            return self.hashes(at, at + 1) ^ U64(1), own
        size = np.maximum(end - start + 2 - n + 1, 0)
        own = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size) - 1
        a, b = np.maximum(at, start[own]), np.minimum(at + n, end[own])
        left, right = (at < start[own]).astype(U64), (at + n > end[own]).astype(U64)
        return self.hashes(a, b) ^ mix(U64(n) * U64(8) + left * U64(2) + right), own


class Table:
    """Counts of the words, or of the n-grams of one length.  The log frequency of an entry is ``base`` of the language plus, where it has a count c there,
    ``log(2 c + 1)``; only the latter are kept."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> None:
        order = np.lexsort((langs, keys))
        keys, self.langs, counts = keys[order], langs[order].astype(np.int32), counts[order].astype(float)
        entries, start = np.unique(keys, return_index=True)
        self.start = np.append(start, len(keys))
        self.index = HashIndex(entries)
        self.gain = np.log(2 * counts + 1)
        self.base = np.log(0.5 / (np.bincount(self.langs, counts, n_langs) + 0.5 * len(entries) + 1))

    def add(self, out: np.ndarray, rows: np.ndarray, found: np.ndarray, weight: np.ndarray) -> None:
        """Adds the log frequencies of entries to the rows of ``out``."""
        n, langs = out.shape
        out += np.bincount(rows, weight, n)[:, None] * self.base[None, :]
        size = self.start[found + 1] - self.start[found]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[found], size)
        cell = np.repeat(rows, size) * langs + self.langs[at]
        out += np.bincount(cell, self.gain[at] * np.repeat(weight, size), n * langs).reshape(n, langs)


class Model:
    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts: by n (0 for words) the hashes, places of languages and counts, as three columns."""
        self.langs = langs
        self.tables = {n: Table(*columns, len(langs)) for n, columns in counts.items()}

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sums by text and language, number of words by text)."""
        words = Words(texts)
        seen = np.bincount(words.row, minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        found = self.tables[0].index.find(words.words())
        hit = found >= 0
        self.tables[0].add(out, words.row[hit], found[hit], np.ones(hit.sum()))
        rest = np.flatnonzero(~hit)
        for n in range(MAX_N, 0, -1):
            if not len(rest):
                break
            hashes, own = words.grams(rest, n)
            found = self.tables[n].index.find(hashes)
            hit = found >= 0
            many = np.bincount(own[hit], minlength=len(rest))
            self.tables[n].add(out, words.row[rest[own[hit]]], found[hit], 1 / many[own[hit]])
            rest = rest[many == 0]
        return out, seen


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = part.column("text").to_pylist()
    for a, b in batches(texts, BLOCK):
        yield a, b, texts[a:b]


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n, hash, count of each block of texts."""
    for part in parts:
        langs = np.array(part.column("lang").to_pylist(), object)
        names, code = np.unique(langs, return_inverse=True)
        for a, b, texts in _texts(part):
            words = Words(texts)
            lang = code[a:b][words.row]
            every = np.arange(len(words.start))
            for n in range(MAX_N + 1):
                hashes, own = words.grams(every, n) if n else (words.words(), every)
                for k in np.unique(lang):
                    keys, counts = np.unique(hashes[lang[own] == k], return_counts=True)
                    size = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * size, pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "n", "hash", "count"])


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    few = stratified_sample(own.select("doc_id", "text", "lang"), "lang", F.col("doc_id"), 13, max_rows).select("text", "lang")
    counts = few.mapInArrow(_counted, "lang string, n int, hash long, count long").groupBy("n", "hash", "lang").agg(F.sum("count").alias("count"))
    counts = materialize(counts, "language-counts")  # of the sample: what reaches the driver is bounded by it
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    place = pa.array(langs, pa.string())
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n in range(MAX_N + 1):
        got = counts.where(F.col("n") == n).select("hash", "lang", "count").toArrow()
        lang = pc.index_in(got.column("lang"), value_set=place).to_numpy()
        found[n] = (got.column("hash").to_numpy().astype(U64), lang, got.column("count").to_numpy())
    return Model(langs, found)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``."""
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the entries of about MAX_ROWS rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in parts:
            names, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
            for a, b, texts in _texts(part) if own is not None else ():
                sums, seen = own.scores(texts)
                best = sums.argmax(axis=1)
                top = sums.max(axis=1)
                share = 1 / np.exp(np.maximum(sums - top[:, None], -700)).sum(axis=1)
                for i in np.flatnonzero(seen):
                    names[a + i] = own.langs[best[i]]
                scores[a:b] = np.where(seen > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    bounded_batches(docs.sparkSession)
    model = train(docs.select("doc_id", "text", "lang"), max_rows)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
