"""Vectorised word and shingle hashing for whole texts.

Texts are encoded once and hashed with NumPy prefix sums: the hash of a word is the difference of
two prefix sums of ``table[byte] * P**i`` (mod 2**64), multiplied by ``P**-start`` and mixed.  A
batch is worked through in blocks of at most ``BLOCK`` bytes, so memory does not depend on the
length of a text.  Word characters are ASCII letters, digits, the underscore and every non-ASCII
byte; words are compared in lower case unless asked otherwise.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 1 << 20
SHINGLE = 5
U64 = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = np.asarray(z, dtype=U64)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    table = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
    kind = np.full(256, 2, np.uint8)
    kind[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
    for c in b"_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        kind[c] = 1
    kind[128:] = 1
    return table, kind


_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_P), run(_INVERSE)


def _block(data: bytes, punctuation: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table, kind = _tables()
    raw = np.frombuffer(data, np.uint8)
    cls = kind[raw]
    if not punctuation:
        cls = cls & 1
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:-1])
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = cls[start] != 0
    start, end = start[keep], end[keep]
    size = 1 << max(BLOCK.bit_length(), len(raw).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(table[raw] * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start, end


def _pieces(text: bytes):
    """A text in pieces of about BLOCK bytes, cut only at white space."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK))
        if cut <= at:
            cut = min([c for c in (text.find(b" ", at + BLOCK), text.find(b"\n", at + BLOCK)) if c >= 0], default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_hashes(texts: list[str | None], lower: bool = True, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offsets of each text's words.

    With ``punctuation`` runs of other characters count as words too.  A null text has no words.
    """
    counts = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    parts: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            hashes, start, _ = _block(b"\n".join(parts), punctuation)
            ends = np.cumsum([len(p) + 1 for p in parts])
            upto = np.searchsorted(start, ends)
            np.add.at(counts, owner, np.diff(upto, prepend=0))
            found.append(hashes)
            parts.clear()
            owner.clear()
            held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        data = (text.lower() if lower else text).encode("utf-8", "replace")
        for piece in _pieces(data) if len(data) > BLOCK else (data,):
            if held + len(piece) > BLOCK:
                flush()
            parts.append(piece)
            owner.append(i)
            held += len(piece) + 1
    flush()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(found) if found else np.zeros(0, U64)), offsets


@cache
def _steps(width: int) -> list[np.uint64]:
    return [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(width)]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words; a text of fewer words has one shingle of all its words, an
    empty one none."""
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    end = np.repeat(offsets[1:], counts)
    padded = np.concatenate([words, np.zeros(width, U64)])
    total = np.zeros(len(at), U64)
    for j, step in enumerate(_steps(width)):
        total += np.where(at + j < end, padded[at + j], U64(0)) * step
    return mix(total), out


def batches(texts: list, limit: int = 4 * BLOCK):
    """Slices of a list of texts of about ``limit`` characters each."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class HashIndex:
    """Open-addressed table from distinct 64-bit hashes to their positions."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.asarray(keys, U64)
        bits = max(8, int(max(len(self.keys), 1) * 4 - 1).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(self.keys)), (self.keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 where absent."""
        out = np.full(len(hashes), -1, np.int32)
        at = (hashes & self.mask).astype(np.int64)
        row = self.slot[at]
        todo = np.flatnonzero(row >= 0)
        at, row = at[todo], row[todo]
        while len(todo):
            hit = self.keys[row] == hashes[todo]
            out[todo[hit]] = row[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & int(self.mask)
            row = self.slot[at]
            go = row >= 0
            todo, at, row = todo[go], at[go], row[go]
        return out
