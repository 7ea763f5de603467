"""The functions and queries under names that Spark SQL can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from markwright.functions.text import CONFUSABLES, DOMAIN, SPACE, TOKEN, TYPOGRAPHY, ZERO_WIDTH


def _raw(pattern: str) -> str:
    return f'r"{pattern}"'


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def definitions() -> dict[str, str]:
    """Signature and body by name.  ``mw_canonicalize`` leaves NFKC out, which SQL lacks."""
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    body = f"translate(t, {_text(ZERO_WIDTH)}, '')"
    body = f"translate({body}, {_text(''.join(CONFUSABLES))}, {_text(''.join(CONFUSABLES.values()))})"
    body = f"replace(translate({body}, {_text(''.join(single))}, {_text(''.join(single.values()))}), '…', '...')"
    body = f"regexp_replace(regexp_replace({body}, {_raw('[ \\t\\f\\x0B\\r]+')}, ' '), {_raw('\\n' + SPACE + '*\\n+')}, '\\n')"
    body = f"regexp_replace({body}, {_raw(f'^{SPACE}+|{SPACE}+$')}, '')"
    return {
        "mw_strip_zero_width": f"(t STRING) RETURNS STRING RETURN translate(t, {_text(ZERO_WIDTH)}, '')",
        "mw_canonicalize": f"(t STRING) RETURNS STRING RETURN {body}",
        "mw_tokenize": f"(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, {_raw(TOKEN)}, 1)",
        "mw_canonical_hash": "(canon STRING) RETURNS STRING RETURN sha2(encode(canon, 'UTF-8'), 256)",
        "mw_message": f"(h STRING, model STRING, created STRING) RETURNS STRING RETURN concat_ws('|', {_text(DOMAIN)}, h, model, created)",
        "mw_detection_score": "(u DOUBLE) RETURNS DOUBLE RETURN -log1p(-u)",
        "mw_neg_log10_p": "(p DOUBLE) RETURNS DOUBLE RETURN -log10(greatest(p, 1e-300D))",
        "mw_iou": "(a INT, b INT, c INT, d INT) RETURNS DOUBLE RETURN CASE WHEN greatest(b, d) > least(a, c) THEN greatest(least(b, d) - greatest(a, c), 0) / (greatest(b, d) - least(a, c)) ELSE 0.0D END",
    }


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions; returns their names."""
    for name, rest in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(definitions())


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """The catalog's queries over a folder of tables as temporary views ``mw_<query>``; nothing runs until a view is read."""
    from markwright.plans.catalog import QUERIES

    for name in names or list(QUERIES):
        QUERIES[name](spark, folder).createOrReplaceTempView(f"mw_{name}")
    return [f"mw_{n}" for n in names or QUERIES]
