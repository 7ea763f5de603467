"""Pieces of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations

from markwright.functions.prf import GOLDEN, MULTIPLY_1, MULTIPLY_2, hmac_pads
from markwright.functions.text import CONFUSABLES, TYPOGRAPHY, ZERO_WIDTH
from markwright.operators.config import EXAMPLE_KEY, MarkConfig

CONFIG = MarkConfig()
WRAP = "18446744073709551616::UHUGEINT"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canon(column: str) -> str:
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    plain = f"translate({column}, {quoted(ZERO_WIDTH)}, '')"
    plain = f"translate({plain}, {quoted(''.join(CONFUSABLES))}, {quoted(''.join(CONFUSABLES.values()))})"
    plain = f"translate({plain}, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    plain = f"replace({plain}, '…', '...')"
    plain = rf"regexp_replace({plain}, '[ \t\f\x0B\r]+', ' ', 'g')"
    plain = rf"regexp_replace({plain}, '\n\s*\n+', chr(10), 'g')"
    return rf"regexp_replace({plain}, '^\s+|\s+$', '', 'g')"


def tokens(column: str) -> str:
    return rf"regexp_extract_all({column}, '[A-Za-z0-9]+(?:''[A-Za-z]+)?|[^\sA-Za-z0-9]')"


def doc_tokens(source: str = "documents", column: str | None = None) -> str:
    """CTEs docs(doc_id, canon), tok(doc_id, pos, token)."""
    column = column or canon("text")
    return f"""docs AS (SELECT doc_id, {column} AS canon FROM {source}),
lists AS (SELECT doc_id, {tokens("canon")} AS l FROM docs),
tok AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM lists)"""


def vocab(size: int = 12_000) -> str:
    return f"""counted AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token),
vocab AS (SELECT row_number() OVER (ORDER BY cnt DESC, token) AS tok_id, token, cnt FROM counted
  QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= {size - 1})"""


ENCODED = "enc AS (SELECT doc_id, pos, tok.token AS token, coalesce(tok_id, 0)::INT AS tok_id FROM tok LEFT JOIN vocab ON tok.token = vocab.token)"


def contexts() -> str:
    return """lagged AS (SELECT *, lag(tok_id, 3) OVER w AS c3, lag(tok_id, 2) OVER w AS c2, lag(tok_id, 1) OVER w AS c1
  FROM enc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ctx AS (SELECT *, pos >= 3 AND row_number() OVER (PARTITION BY doc_id, c3, c2, c1 ORDER BY pos) = 1 AS scored FROM lagged)"""


def _blob(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


def _le(value: str) -> str:
    h = f"lpad(hex({value}::UINTEGER), 8, '0')"
    return f"unhex(concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2)))"


def _word(at: int) -> str:
    order = ", ".join(f"substr(digest, {2 * (at + i) + 1}, 2)" for i in range(7, -1, -1))
    return f"CAST(concat('0x', {order}) AS UBIGINT)"


def seeds(key: bytes = EXAMPLE_KEY) -> str:
    inner, outer = hmac_pads(key)
    message = f"{_blob((3).to_bytes(4, 'little'))} || {_le('c3')} || {_le('c2')} || {_le('c1')}"
    return f"""hashed AS (SELECT *, sha256({_blob(outer)} || unhex(sha256({_blob(inner)} || {message}))) AS digest FROM ctx WHERE scored),
seeded AS (SELECT *, {_word(0)} AS sp, {_word(8)} AS sc, {_word(16)} AS sj FROM hashed)"""


def mix(seed: str, index: str) -> str:
    z = f"((xor({seed}, ({index})::UBIGINT)::UHUGEINT + {GOLDEN}::UHUGEINT) % {WRAP})::UBIGINT"
    for shift, factor in ((30, MULTIPLY_1), (27, MULTIPLY_2)):
        z = f"list_transform([{z}], lambda z: ((xor(z, z >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {WRAP})::UBIGINT)[1]"
    return f"list_transform([{z}], lambda z: xor(z, z >> 31))[1]"


def scores() -> str:
    """CTE scored(doc_id, pos, block, col, u, y)."""
    return f"""blocks AS (SELECT *, ({mix("sp", "tok_id")} % {CONFIG.n_blocks})::INT AS block, ({mix("sj", "0")} % {CONFIG.n_columns})::INT AS col FROM seeded),
costs AS (SELECT *, ((({mix("sc", f"block * {CONFIG.n_columns} + col")}) >> 11)::DOUBLE + 0.5) * pow(2.0, -53) AS u FROM blocks),
scored AS (SELECT doc_id, pos, block, col, u, -ln(1.0 - u) AS y FROM costs)"""


def tail(s: str, n: str) -> str:
    """P(Gamma(n, 1) > s) as a sum of n terms in log space."""
    return f"least(1.0, list_sum(list_transform(range(0, {n}), lambda k: exp(-({s}) + k * ln({s}) - lgamma(k + 1)))))"


def detected(source: str = "documents", column: str | None = None) -> str:
    return f"""{doc_tokens(source, column)},
{vocab()}, {ENCODED}, {contexts()}, {seeds()}, {scores()},
total AS (SELECT d.doc_id, (SELECT 0) AS z, max(len(l.l))::INT AS n_tokens, count(s.y)::INT AS n_scored, coalesce(sum(s.y), 0.0) AS statistic
  FROM docs d JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
tested AS (SELECT *, CASE WHEN n_scored > 0 THEN {tail("statistic", "n_scored")} ELSE 1.0 END AS p_value,
  CASE WHEN n_scored > 0 THEN (statistic - n_scored) / sqrt(n_scored) ELSE 0.0 END AS z_score FROM total)"""


#: CTE split(doc_id, sent_idx, sentence) from docs(doc_id, canon).
SENTENCES = r"""pieces AS (SELECT doc_id, canon, list_filter(list_transform(string_split(regexp_replace(canon, '([.!?])\s+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, concat(' ', chr(10)))), lambda s: s <> '') AS p FROM docs),
words AS (SELECT doc_id, canon, unnest(range(len(p))) AS k, unnest(list_transform(p, lambda s: list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))) AS w FROM pieces),
chunks AS (SELECT doc_id, canon, k, unnest(range(0, greatest(len(w), 1), 60)) AS i, w FROM words),
long AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + 60], ' ') AS sentence FROM chunks WHERE length(array_to_string(w[i + 1:i + 60], ' ')) >= 8),
split AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INT AS sent_idx, sentence FROM long
  UNION ALL SELECT doc_id, 0, canon FROM docs WHERE canon <> '' AND doc_id NOT IN (SELECT doc_id FROM long))"""


def detokenized(tokens: str) -> str:
    """Tokens joined by the rules of ``text.detokenize``.

    Whether a token takes a space depends on itself, on the piece before it (an opening mark binds only if it took no space
    itself) and on the number of double quotes before it.  Runs of opening marks are settled by their first one.
    """
    closing, opening = (f"[{', '.join(map(quoted, marks))}]" for marks in (".,;:!?)]}'\"", "([{\"'"))
    step = f"""lambda s, t: {{'out': s.out || CASE WHEN s.out = '' OR (CASE WHEN t.tok = '"' THEN s.open ELSE list_contains({closing}, t.tok) OR list_contains({opening}, s.last) END) THEN t.tok ELSE ' ' || t.tok END,
 'last': CASE WHEN s.out = '' OR (CASE WHEN t.tok = '"' THEN s.open ELSE list_contains({closing}, t.tok) OR list_contains({opening}, s.last) END) THEN t.tok ELSE ' ' || t.tok END,
 'open': s.open <> (t.tok = '"'), 'tok': ''}}"""
    start = "{'out': '', 'last': '', 'open': false, 'tok': ''}"
    every = f"list_transform({tokens}, lambda t: {{'out': '', 'last': '', 'open': false, 'tok': t}})"
    return f"list_reduce(list_prepend({start}, {every}), {step}).out"


def crc32(text: str) -> str:
    """DuckDB has no CRC: a fold over the bytes, eight conditional shifts each."""
    byte = "xor(c, b)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda z: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)[1]"
    codes = f"list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"
