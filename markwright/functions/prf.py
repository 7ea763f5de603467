"""Keyed pseudorandom values as column expressions.

Spark has no unsigned 64-bit type and, in ANSI mode, no wrapping multiplication.  A 64-bit word is therefore two
BIGINT columns holding its 32-bit halves, and no intermediate value reaches 2**63.  Each step of
the mixer is a projection of its own: nested in one expression the halves would be repeated exponentially.

The key appears only as two precomputed HMAC pads.  These are literals and visible in plans: do not
log plans of keyed queries.
"""

from __future__ import annotations

import hmac
import math
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M32 = (1 << 32) - 1
# Increment and multipliers of the splitmix64 mixer; Euler's constant.
GOLDEN, MULTIPLY_1, MULTIPLY_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
EULER = 0.5772156649015329
GUMBEL_SD = math.pi / math.sqrt(6.0)


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)) or len(key) < 16:
        raise ValueError("a key is at least 16 bytes")
    return bytes(key)


def demo_key(seed: int) -> bytes:
    return sha256(f"demo-key-{seed}".encode()).digest()


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    block = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest of a binary column."""
    inner, outer = hmac_pads(check_key(key))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def le32(value: Column) -> Column:
    """A 32-bit number as four bytes, least first."""
    big = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(big, at, 2) for at in (7, 5, 3, 1)]))


def context_message(tokens: list[Column]) -> Column:
    """Length and token ids of a context, as 32-bit numbers, least byte first."""
    return F.concat(F.lit(len(tokens).to_bytes(4, "little")), *map(le32, tokens))


def _half(digest: Column, at: int) -> Column:
    """Four bytes of a hex digest from byte ``at``, least first, as a number."""
    return F.conv(F.concat(*[F.substring(digest, 2 * (at + i) + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")


SEEDS = ("partition", "cost", "column")


def with_seeds(df: DataFrame, digest: str) -> DataFrame:
    """Adds ``<seed>_h`` and ``<seed>_l`` for the three seeds of a digest column."""
    own = F.col(digest)
    return df.withColumns({f"{name}_{part}": _half(own, 8 * i + (4 if part == "h" else 0)) for i, name in enumerate(SEEDS) for part in "hl"})


def _low(a: Column, b: int) -> Column:
    """``a * b mod 2**32`` for 32-bit operands."""
    return ((a.bitwiseAND(0xFFFF) * F.lit(b)) + F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(M32))


def _times(df: DataFrame, factor: int) -> DataFrame:
    fh, fl = factor >> 32, factor & M32
    h, l = F.col("_h"), F.col("_l")  # noqa: E741
    df = df.withColumns({"_p": l * F.lit(fl & 0xFFFF), "_q": l * F.lit(fl >> 16), "_r": _low(l, fh) + _low(h, fl)})
    low = F.col("_p") + F.shiftleft(F.col("_q").bitwiseAND(0xFFFF), 16)
    return df.withColumns({"_l": low.bitwiseAND(F.lit(M32)), "_h": (F.shiftright(low, 32) + F.shiftright("_q", 16) + F.col("_r")).bitwiseAND(F.lit(M32))}).drop("_p", "_q", "_r")


def _xorshift(df: DataFrame, by: int) -> DataFrame:
    h, l = F.col("_h"), F.col("_l")  # noqa: E741
    moved = F.shiftleft(h, 32 - by).bitwiseOR(F.shiftright(l, by)).bitwiseAND(F.lit(M32))
    return df.withColumns({"_l": l.bitwiseXOR(moved), "_h": h.bitwiseXOR(F.shiftright(h, by))})


def mixed(df: DataFrame, seed: str, index: Column, out: str) -> DataFrame:
    """Adds ``<out>_h`` and ``<out>_l``: the mixer applied to the seed xor a 32-bit index."""
    low = F.col(f"{seed}_l").bitwiseXOR(index.cast("long")) + F.lit(GOLDEN & M32)
    df = df.withColumn("_l", low).withColumn("_h", (F.col(f"{seed}_h") + F.lit(GOLDEN >> 32) + F.shiftright("_l", 32)).bitwiseAND(F.lit(M32)))
    df = df.withColumn("_l", F.col("_l").bitwiseAND(F.lit(M32)))
    df = _xorshift(df, 30)
    df = _times(df, MULTIPLY_1)
    df = _xorshift(df, 27)
    df = _times(df, MULTIPLY_2)
    df = _xorshift(df, 31)
    return df.withColumnsRenamed({"_h": f"{out}_h", "_l": f"{out}_l"})


def modulo(word: str, n: int) -> Column:
    """The unsigned remainder by ``n`` < 2**30."""
    return (((F.col(f"{word}_h") % n) * F.lit((1 << 32) % n) + F.col(f"{word}_l") % n) % n).cast("int")


def uniform(word: str) -> Column:
    """A number in (0, 1) from the upper 53 bits."""
    top = F.col(f"{word}_h") * F.lit(1 << 21) + F.shiftright(F.col(f"{word}_l"), 11)
    return (top + F.lit(0.5)) * F.lit(2.0**-53)


def gumbel_cost(u: Column) -> Column:
    """Minus a standardised Gumbel variate."""
    return -((-F.log(-F.log(u)) - EULER) / GUMBEL_SD)


def detection_score(u: Column) -> Column:
    return -F.log1p(-u)


# The same values in NumPy, whose 64-bit words wrap, for operators that run in Python workers.


def np_mix(x: np.ndarray) -> np.ndarray:
    z = np.asarray(x, np.uint64) + np.uint64(GOLDEN)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MULTIPLY_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MULTIPLY_2)
    return z ^ (z >> np.uint64(31))


def np_uniform(z: np.ndarray) -> np.ndarray:
    return ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def np_seeds(key: bytes, context: tuple[int, ...]) -> dict[str, np.uint64]:
    message = len(context).to_bytes(4, "little") + np.array(context, "<u4").tobytes()
    words = np.frombuffer(hmac.digest(key, message, "sha256")[:24], "<u8")
    return dict(zip(SEEDS, words, strict=True))


def np_context_seeds(key: bytes, contexts: np.ndarray) -> np.ndarray:
    """The seeds of each row of token ids: one column for each of ``SEEDS``."""
    inner, outer = map(sha256, hmac_pads(check_key(key)))
    inner.update(contexts.shape[1].to_bytes(4, "little"))
    data, size, words = np.ascontiguousarray(contexts, "<u4").tobytes(), 4 * contexts.shape[1], bytearray()
    for i in range(len(contexts)):
        own, told = inner.copy(), outer.copy()
        own.update(data[i * size : (i + 1) * size])
        told.update(own.digest())
        words += told.digest()[:24]
    return np.frombuffer(bytes(words), "<u8").reshape(-1, len(SEEDS))


def np_blocks(seed: np.uint64, vocab: int, blocks: int) -> np.ndarray:
    return (np_mix(np.arange(vocab, dtype=np.uint64) ^ seed) % np.uint64(blocks)).astype(np.int64)


def np_costs(seed: np.uint64, blocks: int, columns: int) -> np.ndarray:
    u = np_uniform(np_mix(np.arange(blocks * columns, dtype=np.uint64) ^ seed)).reshape(blocks, columns)
    return -((-np.log(-np.log(u)) - EULER) / GUMBEL_SD)


def np_column(seed: np.uint64, columns: int) -> int:
    return int(np_mix(np.array([0], np.uint64) ^ seed)[0] % np.uint64(columns))
