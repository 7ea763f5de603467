"""Text functions as column expressions: canonical form, tokens, sentences, hashes."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters without a visible form that canonical text drops.
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u180e\u034f"

# Look-alikes and the Latin letters they stand for.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԝ": "w", "ɡ": "g", "ӏ": "l", "є": "e",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ρ": "p", "ι": "i", "α": "a", "κ": "k", "ℓ": "l", "℮": "e", "ɑ": "a", "ǀ": "l", "ᴀ": "A",
}

# Typographic characters and their plain forms.
TYPOGRAPHY = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "‹": "'", "›": "'",
    "–": "-", "—": "-", "‒": "-", "‐": "-", "‑": "-", "−": "-", "…": "...",
    "\u00a0": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\u3000": " ", "\u2028": "\n", "\u2029": "\n",
}

TOKEN = r"([A-Za-z0-9]+(?:'[A-Za-z]+)?|[^\sA-Za-z0-9\x0B\x1C-\x1F\x85\p{Z}])"
PYTHON_TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?|[^\sA-Za-z0-9]"  # the same tokens where Python reads them
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"  # white space as Unicode has it, with the four information separators
DOMAIN = "markwright"  # first part of every signed message


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def map_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def normalize_typography(text: Column) -> Column:
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    many = {k: v for k, v in TYPOGRAPHY.items() if len(v) > 1}
    plain = F.translate(text, "".join(single), "".join(single.values()))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), many.items(), plain)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; Spark has no such function, so non-ASCII text goes through an Arrow-batched UDF, with null in place of ASCII text."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def collapse_space(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[ \t\f\x0B\r]+", " ")
    lines = F.regexp_replace(spaced, rf"\n{SPACE}*\n+", "\n")
    return F.regexp_replace(lines, rf"^{SPACE}+|{SPACE}+$", "")


def canonicalize(text: Column, compatibility: bool = True) -> Column:
    """Canonical form: NFKC, no zero-width characters, look-alikes and typography made plain, white space collapsed.

    ``compatibility=False`` leaves NFKC out, for text that is known to be in that form; the expression is then
    free of Python.
    """
    composed = nfkc(text) if compatibility else text
    return collapse_space(normalize_typography(map_confusables(strip_zero_width(composed))))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def detokenize(tokens: Column) -> Column:
    """Join tokens with spaces, but none before closing marks, none after an opening mark that itself took no space,
    and double quotes in pairs.

    A fold that carries the text so far, its last piece and whether a double quote is open.
    """
    closing, opening = list(".,;:!?)]}'\""), list("([{\"'")
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(False).alias("open"))

    def step(s: Column, token: Column) -> Column:
        tight = F.when(token == '"', s["open"]).otherwise(token.isin(closing) | s["last"].isin(opening))
        piece = F.when((s["out"] == "") | tight, token).otherwise(F.concat(F.lit(" "), token))
        return F.struct(F.concat(s["out"], piece).alias("out"), piece.alias("last"), (s["open"] != (token == '"')).alias("open"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def split_sentences(canonical: Column, max_words: int = 60, min_chars: int = 8) -> Column:
    """Sentences of canonical text, cut to ``max_words`` words; pieces under ``min_chars`` are left out
    unless nothing else is there."""
    parts = F.transform(F.split(canonical, rf"(?<=[.!?]){SPACE}+(?=[A-Z\"'(\[])"), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))

    def chunks(sentence: Column) -> Column:
        words = F.filter(F.split(sentence, rf"{SPACE}+"), lambda w: w != "")
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(max_words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(max_words)), " "))

    kept = F.filter(F.flatten(F.transform(F.filter(parts, lambda s: s != ""), chunks)), lambda c: F.length(c) >= min_chars)
    return F.when(F.size(kept) > 0, kept).when(F.length(canonical) > 0, F.array(canonical)).otherwise(F.array().cast("array<string>"))


def canonical_hash(canonical: Column) -> Column:
    return F.sha2(F.encode(canonical, "UTF-8"), 256)


def message(digest: Column, model: Column, created: Column) -> Column:
    return F.concat_ws("|", F.lit(DOMAIN), digest, model, created)
