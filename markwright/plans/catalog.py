"""Queries by name, with the DuckDB SQL that must give the same rows.

Published doubles are rounded on both sides: the engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.functions import ed25519, prf, stats, text
from markwright.operators import attacks, detect, evaluate, generate, ngrams, registry, retrieval
from markwright.operators.config import EXAMPLE_KEY
from markwright.plans import oracle as o
from markwright.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.canonical_docs(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str, column: str = "canon") -> tuple[DataFrame, DataFrame]:
    """Tokens of each document, written once, and the vocabulary.

    Documents are dealt out by id: nothing after it has an exchange, so a file of few row groups would keep all work in as many tasks.
    """
    docs = _docs(spark, sf_dir).repartition("doc_id")
    lists = materialize(ngrams.token_lists(ngrams.canonical_docs(docs) if column == "canon" else docs, column), "tokens")
    return lists, materialize(ngrams.vocabulary(ngrams.token_table(lists, None)), "vocab")


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbered tokens of each document, and the vocabulary."""
    lists, vocab = tokens(spark, sf_dir)
    return ngrams.encode_lists(lists, vocab), vocab


def _positions(spark, sf_dir, columns):
    lists, vocab = tokens(spark, sf_dir)
    return detect.scored_positions(lists, columns, EXAMPLE_KEY, vocab=vocab)


@query(f"SELECT doc_id, {o.canon('text')} AS canon FROM documents")
def canonicalize_docs(spark, sf_dir):
    return canonical(spark, sf_dir)


@query(f"SELECT doc_id, sha256({o.canon('text')}) AS canonical_hash FROM documents")
def canonical_hash(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", text.canonical_hash(F.col("canon")).alias("canonical_hash"))


@query(f"WITH {o.doc_tokens()} SELECT doc_id, len(l) AS n_tokens, sha256(array_to_string(l, ' ')) AS tokens_sha256 FROM lists")
def tokenize_docs(spark, sf_dir):
    tokens = canonical(spark, sf_dir).select("doc_id", text.tokenize(F.col("canon")).alias("l"))
    return tokens.select("doc_id", F.size("l").cast("long").alias("n_tokens"), F.sha2(F.array_join("l", " "), 256).alias("tokens_sha256"))


@query(f"WITH {o.doc_tokens()} SELECT token, count(*) AS cnt FROM tok GROUP BY token")
def token_counts(spark, sf_dir):
    return ngrams.token_counts(ngrams.token_table(canonical(spark, sf_dir)))


@query(f"WITH {o.doc_tokens()}, {o.vocab()} SELECT tok_id::INT AS tok_id, token, cnt FROM vocab UNION ALL SELECT 0, '<unk>', 0")
def vocab_topk(spark, sf_dir):
    return ngrams.vocabulary(ngrams.token_table(canonical(spark, sf_dir))).drop("le")


@query(
    f"""WITH {o.doc_tokens()}, {o.vocab()}, {o.ENCODED}, c AS (SELECT tok_id, count(*) AS c FROM enc GROUP BY tok_id),
every AS (SELECT v.tok_id, coalesce(c.c, 0) AS c FROM (SELECT tok_id FROM vocab UNION ALL SELECT 0) v LEFT JOIN c ON c.tok_id = v.tok_id)
SELECT tok_id::INT AS tok_id, round((c + 0.1) / (sum(c) OVER () + 0.1 * count(*) OVER ()), 12) AS p FROM every"""
)
def unigram_probs(spark, sf_dir):
    rows, vocab = encoded(spark, sf_dir)
    return ngrams.unigram_probs(rows, vocab).withColumn("p", F.round("p", 12))


_NGRAMS = f"WITH {o.doc_tokens()}, {o.vocab()}, {o.ENCODED}, g AS (SELECT lag(tok_id, 2) OVER w AS a, lag(tok_id, 1) OVER w AS b, tok_id AS w FROM enc WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"


@query(f"{_NGRAMS} SELECT b AS w1, w, count(*) AS cnt FROM g WHERE b IS NOT NULL GROUP BY b, w")
def bigram_counts(spark, sf_dir):
    return ngrams.bigram_counts(ngrams.ngram_rows(encoded(spark, sf_dir)[0]))


@query(f"{_NGRAMS} SELECT a AS w1, b AS w2, w, count(*) AS cnt FROM g WHERE a IS NOT NULL GROUP BY a, b, w")
def trigram_counts(spark, sf_dir):
    return ngrams.trigram_counts(ngrams.ngram_rows(encoded(spark, sf_dir)[0]))


@query(
    f"""{_NGRAMS}, b2 AS (SELECT b AS w1, w, count(*) AS cnt FROM g WHERE b IS NOT NULL GROUP BY b, w),
t3 AS (SELECT a AS w1, b AS w2, w, count(*) AS cnt FROM g WHERE a IS NOT NULL GROUP BY a, b, w),
one AS (SELECT tok_id, (c + 0.1) / (sum(c) OVER () + 0.1 * count(*) OVER ()) AS p FROM
  (SELECT v.tok_id, coalesce(c.c, 0) AS c FROM (SELECT tok_id FROM vocab UNION ALL SELECT 0) v LEFT JOIN (SELECT tok_id, count(*) AS c FROM enc GROUP BY tok_id) c ON c.tok_id = v.tok_id)),
two AS (SELECT b2.w1, b2.w, greatest(cnt - 0.75, 0.0) / total + 0.75 * types / total * one.p AS p
  FROM b2 JOIN (SELECT w1, sum(cnt) AS total, count(*) AS types FROM b2 GROUP BY w1) x ON x.w1 = b2.w1 JOIN one ON one.tok_id = b2.w)
SELECT t3.w1, t3.w2, t3.w, round(greatest(cnt - 0.75, 0.0) / total + 0.75 * types / total * two.p, 9) AS p
FROM t3 JOIN (SELECT w1, w2, sum(cnt) AS total, count(*) AS types FROM t3 GROUP BY w1, w2) x ON x.w1 = t3.w1 AND x.w2 = t3.w2 JOIN two ON two.w1 = t3.w2 AND two.w = t3.w"""
)
def ngram_interpolated_prob(spark, sf_dir):
    lists, vocab = tokens(spark, sf_dir)
    rows = ngrams.encode_lists(lists, vocab)
    found = ngrams.interpolated_probs(ngrams.bigram_counts(ngrams.ngram_rows(rows)), ngrams.trigram_counts_by_context(lists, vocab), ngrams.unigram_probs(rows, vocab))
    return found.withColumn("p", F.round("p", 9))


_CTX = f"WITH {o.doc_tokens()}, {o.vocab()}, {o.ENCODED}, {o.contexts()}"


@query(f"{_CTX} SELECT doc_id, pos::INT AS pos, c3, c2, c1, tok_id FROM ctx WHERE scored")
def context_first_occurrence(spark, sf_dir):
    return _positions(spark, sf_dir, ["c3", "c2", "c1", "tok_id"])


@query(f"{_CTX}, {o.seeds()} SELECT doc_id, pos::INT AS pos, (sp >> 32)::BIGINT AS partition_h, (sp % 4294967296)::BIGINT AS partition_l, (sc >> 32)::BIGINT AS cost_h, (sc % 4294967296)::BIGINT AS cost_l, (sj >> 32)::BIGINT AS column_h, (sj % 4294967296)::BIGINT AS column_l FROM seeded")
def prf_seeds(spark, sf_dir):
    return _positions(spark, sf_dir, [f"{s}_{part}" for s in prf.SEEDS for part in "hl"])


_SCORES = f"{_CTX}, {o.seeds()}, {o.scores()}"


@query(f"{_SCORES} SELECT doc_id, pos::INT AS pos, block, col FROM scored")
def prf_block_column(spark, sf_dir):
    return _positions(spark, sf_dir, ["block", "col"])


@query(f"{_SCORES} SELECT doc_id, pos::INT AS pos, u FROM scored")
def prf_cost_uniform(spark, sf_dir):
    return _positions(spark, sf_dir, ["u"])


@query(f"{_SCORES} SELECT doc_id, pos::INT AS pos, round(y, 9) AS y FROM scored UNION ALL SELECT doc_id, pos::INT, NULL FROM ctx WHERE NOT scored")
def position_scores(spark, sf_dir):
    lists, vocab = tokens(spark, sf_dir)
    return detect.position_scores(lists, EXAMPLE_KEY, vocab=vocab).where("pos IS NOT NULL").select("doc_id", "pos", F.round("y", 9).alias("y"))


_DETECTED = "doc_id, n_tokens, n_scored, round(statistic, 6) AS statistic, round(p_value, 9) AS p_value, round(z_score, 6) AS z_score, n_scored > 0 AND p_value < 0.01 AS detected"


def _detections(spark, sf_dir, column="canon"):
    lists, vocab = tokens(spark, sf_dir, column)
    return detect.tested_scores(detect.document_scores(lists, EXAMPLE_KEY, vocab=vocab))


def _windows(spark, sf_dir):
    lists, vocab = tokens(spark, sf_dir)
    return detect.document_windows(lists, EXAMPLE_KEY, vocab=vocab)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_tokens", "n_scored", F.round("statistic", 6).alias("statistic"), F.round("p_value", 9).alias("p_value"), F.round("z_score", 6).alias("z_score"), "detected")


@query(f"WITH {o.detected()} SELECT {_DETECTED} FROM tested")
def detect_docs(spark, sf_dir):
    return _shown(_detections(spark, sf_dir))


@query(f"WITH {o.detected(column='text')} SELECT {_DETECTED} FROM tested")
def detect_docs_naive(spark, sf_dir):
    """Without canonical text."""
    return _shown(_detections(spark, sf_dir, "text"))


_WINDOWS = f"""{_SCORES}, sized AS (SELECT doc_id, len(l) AS n, greatest(len(l) - 120, 0) AS last FROM lists WHERE len(l) > 0),
starts AS (SELECT doc_id, n, unnest(range(0, last + 1, 30)) AS start, last, (last // 30) * 30 AS reg FROM sized
  UNION ALL SELECT doc_id, n, last, last, (last // 30) * 30 FROM sized WHERE (last // 30) * 30 + 120 < n),
numbered AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_windows FROM starts),
win AS (SELECT w.doc_id, w.start, least(w.start + 120, w.n) AS stop, w.n_windows, count(s.y) AS n_scored, coalesce(sum(s.y), 0.0) AS statistic
  FROM numbered w LEFT JOIN scored s ON s.doc_id = w.doc_id AND s.pos >= w.start AND s.pos < w.start + 120 GROUP BY ALL)"""


@query(f"{_WINDOWS} SELECT doc_id, start::INT AS start, stop::INT AS stop, n_windows::INT AS n_windows, n_scored::INT AS n_scored, round(statistic, 6) AS statistic, CASE WHEN n_scored > 0 THEN round(least(1.0, n_windows * {o.tail('statistic', 'n_scored')}), 9) ELSE 1.0 END AS p_corrected FROM win")
def localize_windows(spark, sf_dir):
    found = detect.tested(_windows(spark, sf_dir))
    return found.select("doc_id", "start", F.col("end").alias("stop"), "n_windows", "n_scored", F.round("statistic", 6).alias("statistic"), F.round("p_corrected", 9).alias("p_corrected"))


_ALPHA = 0.5  # unmarked documents have few significant windows at 0.01


@query(
    f"""{_WINDOWS}, hit AS (SELECT * FROM win WHERE n_scored >= 12 AND n_windows * {o.tail('statistic', 'n_scored')} < {_ALPHA}),
flagged AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM flagged),
merged AS (SELECT doc_id, island, min(start) AS a, max(stop) AS b, max(n_windows) AS n_windows FROM isle GROUP BY doc_id, island),
stat AS (SELECT m.doc_id, a, b, n_windows, count(s.y) AS n_scored, sum(s.y) AS statistic FROM merged m JOIN scored s ON s.doc_id = m.doc_id AND s.pos >= a AND s.pos < b GROUP BY ALL)
SELECT doc_id, a::INT AS token_start, b::INT AS token_end, n_scored::INT AS n_scored, round(statistic, 6) AS statistic, round(least(1.0, n_windows * {o.tail('statistic', 'n_scored')}), 9) AS p_value FROM stat"""
)
def localize_segments(spark, sf_dir):
    found = detect.segments(_windows(spark, sf_dir), alpha=_ALPHA)
    return found.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 9)})


def _labelled(spark, sf_dir):
    """Detection scores with the quality label as the positive class."""
    found = _detections(spark, sf_dir).select("doc_id", F.round("z_score", 6).alias("score"))
    return found.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive")), "doc_id")


_LABELLED = f"WITH {o.detected()}, lab AS (SELECT t.doc_id, round(z_score, 6) AS score, quality = 1 AS positive FROM tested t JOIN labels l ON l.doc_id = t.doc_id)"


@query(
    f"""{_LABELLED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM lab)
SELECT count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg,
round((sum(rk) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 9) AS auc FROM r"""
)
def auc_by_label(spark, sf_dir):
    return stats.auc(_labelled(spark, sf_dir), "score", "positive").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query(
    f"""{_LABELLED}, t AS (SELECT DISTINCT score AS threshold FROM lab UNION ALL SELECT 'inf'::DOUBLE)
SELECT threshold, round(count(*) FILTER (NOT positive AND score >= threshold) / (SELECT count(*) FROM lab WHERE NOT positive), 9) AS fpr,
round(count(*) FILTER (positive AND score >= threshold) / (SELECT count(*) FROM lab WHERE positive), 9) AS tpr FROM t, lab GROUP BY threshold"""
)
def roc_points(spark, sf_dir):
    return stats.roc(_labelled(spark, sf_dir), "score", "positive").select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    f"""WITH {o.detected()}, s AS (SELECT round(-log10(greatest(p_value, 1e-300)), 6) AS score FROM tested),
r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM s)
SELECT score AS threshold FROM r WHERE k = least(greatest(ceil(0.99 * n), 0), n - 1)"""
)
def empirical_threshold(spark, sf_dir):
    found = _detections(spark, sf_dir).select(F.round("neg_log10_p", 6).alias("score"))
    return stats.empirical_threshold(found, "score", 0.01)


@query(f"WITH {o.detected()} SELECT lang, count(*) AS n, round(avg((n_scored > 0 AND p_value < 0.01)::INT), 9) AS fpr, round(avg(n_scored), 6) AS mean_scored FROM tested t JOIN documents d ON d.doc_id = t.doc_id GROUP BY lang")
def fpr_by_lang(spark, sf_dir):
    found = _detections(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("detected").cast("double")), 9).alias("fpr"), F.round(F.avg("n_scored"), 6).alias("mean_scored"))


@query(f"SELECT sha256({o.canon('text')}) AS canonical_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    hashed = canonical(spark, sf_dir).select("doc_id", text.canonical_hash(F.col("canon")).alias("canonical_hash"))
    return hashed.groupBy("canonical_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_TURNS = f"""rec AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, sha256({o.canon("text")}) AS h, text FROM conversations WHERE role = 'assistant'),
firsts AS (SELECT h, min(id) AS id FROM rec GROUP BY h)"""


def _turn_records(spark, sf_dir):
    """Assistant turns as records without signatures."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    hashed = registry.assign_ids(turns, ["conv_id", "turn"], derived={"canonical_hash": text.canonical_hash(text.canonicalize(F.col("text")))})
    return hashed.select("id", "canonical_hash", "text")


@query(f"WITH {_TURNS} SELECT c.conv_id, c.turn, f.id AS record_id FROM conversations c LEFT JOIN firsts f ON f.h = sha256({o.canon('c.text')})")
def registry_lookup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("canonical_hash", text.canonical_hash(text.canonicalize(F.col("text"))))
    return registry.lookup(turns, _turn_records(spark, sf_dir)).select("conv_id", "turn", F.col("record.id").alias("record_id"))


_VARIANT = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(substr(text, 1, 1), chr(8203), substr(text, 2)) ELSE concat(text, ' added') END"


@query(
    f"""WITH rec AS (SELECT doc_id AS id, text, sha256({o.canon("text")}) AS h FROM documents), firsts AS (SELECT h, min(id) AS id FROM rec GROUP BY h),
sus AS (SELECT doc_id, {_VARIANT} AS text FROM documents), hashed AS (SELECT doc_id, text, sha256({o.canon("text")}) AS h FROM sus)
SELECT s.doc_id, CASE WHEN f.id IS NULL THEN 'unknown' WHEN r.text = s.text THEN 'exact' ELSE 'normalized' END AS status, f.id AS record_id
FROM hashed s LEFT JOIN firsts f ON f.h = s.h LEFT JOIN rec r ON r.id = f.id"""
)
def registry_verdict_exact(spark, sf_dir):
    """Every document is registered; as a suspect each comes unchanged, with an invisible character, or with a word added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = docs.withColumn("canonical_hash", text.canonical_hash(text.canonicalize(F.col("text")))).withColumnRenamed("doc_id", "id")
    kind = F.col("doc_id") % 3
    longer = F.concat(F.substring("text", 1, 1), F.lit("\u200b"), F.expr("substring(text, 2)"))
    suspects = docs.withColumn("text", F.when(kind == 0, F.col("text")).when(kind == 1, longer).otherwise(F.concat("text", F.lit(" added"))))
    return registry.exact_verdicts(suspects.withColumn("canonical_hash", text.canonical_hash(text.canonicalize(F.col("text")))), kept)


@query(f'WITH docs AS (SELECT doc_id, {o.canon("text")} AS canon FROM documents), {o.SENTENCES} SELECT doc_id, sent_idx, sentence FROM split')
def sentence_split(spark, sf_dir):
    return retrieval.sentences(canonical(spark, sf_dir))


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS id, list_inner_product(v, embedding::DOUBLE[]) AS score FROM q, embeddings)
SELECT qid, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 8"""
)
def embedding_topk(spark, sf_dir):
    """Exact search; the query set is every row whose id is divisible by 20."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = retrieval.dense_topk(index.where("id % 20 = 0").withColumnRenamed("id", "qid"), index)
    return found.withColumn("score", F.round("score", 6))


_HITS = """WITH q AS (SELECT vec_id AS qid, label AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, query_id, vec_id AS id, label AS doc_id, list_inner_product(v, embedding::DOUBLE[]) AS score FROM q, embeddings),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 8),
best AS (SELECT query_id, qid, doc_id, max(score) AS sim FROM top GROUP BY ALL),
voted AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) = 1)::INT AS vote FROM best),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
hit AS (SELECT v.query_id, v.doc_id, sum(sim) / n.n AS score, sum(vote) / n.n AS coverage, CASE WHEN count(*) < n.n THEN greatest(max(sim), 0.0) ELSE max(sim) END AS max_sim, (count(*) FILTER (sim >= 0.8))::INT AS n_strong FROM voted v JOIN n ON n.query_id = v.query_id GROUP BY v.query_id, v.doc_id, n.n)"""


def _hits(spark, sf_dir, k):
    """Vectors as sentences and labels as documents."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    queries = rows.where("id % 20 = 0")
    top = retrieval.dense_topk(queries.select(F.col("id").alias("qid"), "vec"), rows.select("id", "vec"))
    named = top.join(queries.select(F.col("id").alias("qid"), F.col("label").alias("query_id")), "qid").join(rows.select("id", F.col("label").alias("doc_id")), "id")
    sizes = queries.groupBy(F.col("label").alias("query_id")).agg(F.count(F.lit(1)).alias("n_sents"))
    return retrieval.document_hits(named.select("query_id", F.col("qid").alias("sent_idx"), "doc_id", "score"), sizes, k)


@query(f"{_HITS} SELECT query_id, doc_id, round(score, 6) AS score, round(coverage, 6) AS coverage, round(max_sim, 6) AS max_sim, n_strong FROM hit")
def retrieval_doc_scores(spark, sf_dir):
    return _hits(spark, sf_dir, None).select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("score", "coverage", "max_sim")], "n_strong")


@query(f"{_HITS}, first AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_strong DESC, coverage DESC, doc_id) = 1) SELECT count(*) AS n, round(avg((query_id = doc_id)::INT), 9) AS recall_at_1 FROM first")
def retrieval_recall_at_1(spark, sf_dir):
    return _hits(spark, sf_dir, 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("query_id") == F.col("doc_id")).cast("double")), 9).alias("recall_at_1"))


@query(
    f"""{_WINDOWS}, hit AS (SELECT doc_id, start, stop FROM win WHERE n_scored >= 12 AND n_windows * {o.tail('statistic', 'n_scored')} < {_ALPHA}),
truth AS (SELECT doc_id, len(l) // 4 AS a, len(l) // 2 AS b FROM lists)
SELECT t.doc_id, round(max(CASE WHEN h.doc_id IS NULL THEN 0.0 WHEN greatest(b, stop) - least(a, start) > 0 THEN greatest(0, least(b, stop) - greatest(a, start)) / (greatest(b, stop) - least(a, start)) ELSE 0.0 END), 9) AS best
FROM truth t LEFT JOIN hit h ON h.doc_id = t.doc_id GROUP BY t.doc_id"""
)
def iou_spans(spark, sf_dir):
    """Overlap of significant windows with the second quarter of each document."""
    found = detect.tested(_windows(spark, sf_dir).where("n_scored >= 12")).where(F.col("p_corrected") < _ALPHA)
    truth = canonical(spark, sf_dir).select("doc_id", F.size(text.tokenize(F.col("canon"))).alias("n")).selectExpr("doc_id", "n div 4 AS span_start", "n div 2 AS span_end")
    best = evaluate.best_overlap(truth, found.select("doc_id", F.col("start").alias("token_start"), F.col("end").alias("token_end")))
    return best.withColumn("best", F.round("best", 9))


def _unit(*parts: str) -> str:
    told = " || ':' || ".join(parts)
    return f"(CAST(concat('0x', substr(sha256({told}), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_ZW = attacks.ZERO_WIDTH


@query(
    f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS word FROM w),
c AS (SELECT *, {_unit("'0'", "doc_id::VARCHAR", "'zw'", "i::VARCHAR")} AS u, floor({_unit("'0'", "doc_id::VARCHAR", "'zw-at'", "i::VARCHAR")} * (length(word) - 1))::INT + 1 AS spot, floor({_unit("'0'", "doc_id::VARCHAR", "'zw-kind'", "i::VARCHAR")} * 3)::INT + 1 AS kind FROM e)
SELECT doc_id, string_agg(CASE WHEN length(word) > 2 AND u < 0.5 THEN substr(word, 1, spot) || substr('{_ZW}', kind, 1) || substr(word, spot + 1) ELSE word END, ' ' ORDER BY i) AS attacked_text FROM c GROUP BY doc_id"""
)
def attack_zero_width(spark, sf_dir):
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("zw", "zero_width", "2", {"p": 0.5})).select("doc_id", "attacked_text")


_PLAIN, _ALIKE = "".join(attacks.LOOK_ALIKE), "".join(attacks.LOOK_ALIKE.values())


@query(
    f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS word FROM w),
p AS (SELECT *, list_filter(range(1, length(word) + 1), lambda k: contains('{_PLAIN}', substr(word, k, 1))) AS places, {_unit("'0'", "doc_id::VARCHAR", "'hg'", "i::VARCHAR")} AS u FROM e),
c AS (SELECT *, places[floor({_unit("'0'", "doc_id::VARCHAR", "'hg-at'", "i::VARCHAR")} * len(places))::INT + 1] AS spot FROM p)
SELECT doc_id, string_agg(CASE WHEN u < 0.3 AND len(places) > 0 THEN substr(word, 1, spot - 1) || translate(substr(word, spot, 1), '{_PLAIN}', '{_ALIKE}') || substr(word, spot + 1) ELSE word END, ' ' ORDER BY i) AS attacked_text FROM c GROUP BY doc_id"""
)
def attack_homoglyph(spark, sf_dir):
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("hg", "homoglyph", "2", {"p": 0.3})).select("doc_id", "attacked_text")


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '"([^\n]*?)"', '“\1”', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\pL\pN_])''([\pL\pN_])', '\1’\2', 'g'), '([\pL\pN_])''([\pL\pN_])', '\1’\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\pL\pN_])''', '\1‘', 'g'), '(^|[^\pL\pN_])''', '\1‘', 'g') AS t FROM b)
SELECT doc_id, replace(replace(replace(t, '--', '—'), '...', '…'), '  ', ' ') AS attacked_text FROM c"""
)
def attack_autoformat(spark, sf_dir):
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("af", "autoformat", "2")).select("doc_id", "attacked_text")


@query(f"WITH {o.doc_tokens(column='text')}, kept AS (SELECT doc_id, l[1:150] AS l FROM lists) SELECT doc_id, {o.detokenized('l')} AS attacked_text FROM kept")
def attack_truncate(spark, sf_dir):
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("cut", "truncate", "2", {"n": 150})).select("doc_id", "attacked_text")


@query(
    f"""WITH {o.doc_tokens(column='text')}, kept AS (SELECT doc_id, list(token ORDER BY pos) AS l FROM tok WHERE {_unit("'0'", "doc_id::VARCHAR", "'del'", "pos::VARCHAR")} >= 0.1 GROUP BY doc_id)
SELECT d.doc_id, {o.detokenized("coalesce(k.l, []::VARCHAR[])")} AS attacked_text FROM lists d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
)
def attack_delete(spark, sf_dir):
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("del", "delete", "2", {"p": 0.1})).select("doc_id", "attacked_text")


def _pool(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slot"), "text")


@query(
    rf"""WITH pool AS (SELECT count(*) AS slots FROM benchmark), docs AS (SELECT item_id AS doc_id, {o.canon("text")} AS canon FROM benchmark), {o.SENTENCES},
sents AS (SELECT doc_id AS slot, list(sentence ORDER BY sent_idx) AS s FROM split GROUP BY doc_id),
own AS (SELECT d.doc_id, text, len({o.tokens("text")}) AS n, floor({_unit("'0'", "doc_id::VARCHAR", "'pool'")} * slots)::BIGINT AS slot FROM documents d, pool),
joined AS (SELECT own.*, s, list_transform(s, lambda x: len({o.tokens("x")})) AS sizes FROM own JOIN sents ON sents.slot = own.slot),
took AS (SELECT *, greatest(len(list_filter(range(1, len(s) + 1), lambda i: coalesce(list_sum(sizes[1:i - 1]), 0) < floor(n * 3.0))), 1) AS k FROM joined),
cut AS (SELECT *, floor({_unit("'0'", "doc_id::VARCHAR", "'cut'")} * (k + 1))::INT AS c FROM took),
parts AS (SELECT *, array_to_string(s[1:c], ' ') AS head, array_to_string(s[c + 1:k], ' ') AS rest FROM cut)
SELECT doc_id, array_to_string(list_filter([head, text, rest], lambda x: x <> ''), ' ') AS attacked_text, len({o.tokens("head")})::INT AS span_start, (len({o.tokens("head")}) + n)::INT AS span_end FROM parts"""
)
def attack_dilute(spark, sf_dir):
    """Documents inside sentences of a benchmark passage, with the true span."""
    return attacks.apply(_docs(spark, sf_dir), attacks.Attack("dilute", "dilute", "2", {"ratio": 3.0}), pool=_pool(spark, sf_dir)).select("doc_id", "attacked_text", "span_start", "span_end")


@query(f"WITH {o.doc_tokens()} SELECT doc_id, {o.detokenized('l')} AS text FROM lists")
def detokenized_docs(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", text.detokenize(text.tokenize(F.col("canon"))).alias("text"))


@query(
    rf"""WITH docs AS (SELECT item_id AS doc_id, {o.canon("text")} AS canon FROM benchmark), {o.SENTENCES},
s AS (SELECT doc_id, sent_idx, ' ' || trim(regexp_replace(lower(sentence), '\s+', ' ', 'g')) || ' ' AS s FROM split),
g AS (SELECT doc_id, sent_idx, unnest(list_transform(range(1, greatest(length(s) - n + 2, 1)), lambda i: substr(s, i, n))) AS g FROM s, (SELECT unnest([3, 4, 5]) AS n)),
c AS (SELECT DISTINCT g, {o.crc32('g')} AS crc FROM (SELECT DISTINCT g FROM g)),
v AS (SELECT doc_id, sent_idx, ((crc >> 1) % 4096)::INT AS bucket, sum(CASE WHEN crc % 2 = 1 THEN 1 ELSE -1 END) AS v FROM g JOIN c USING (g) GROUP BY ALL HAVING v <> 0),
w AS (SELECT *, sign(v) * ln(1 + abs(v)) AS w FROM v)
SELECT doc_id, sent_idx, bucket, round((w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent_idx)))::FLOAT::DOUBLE, 6) AS w FROM w"""
)
def hashing_features(spark, sf_dir):
    """Sparse features of the sentences of the benchmark passages."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), text.canonicalize(F.col("text")).alias("canon"))
    return retrieval.hashed_features(retrieval.sentences(items)).withColumn("w", F.round(F.col("w").cast("double"), 6))


_SECRET = bytes(range(100, 132))
_CREATED = "2024-01-01T00:00:00Z"


@query(f"SELECT row_number() OVER (ORDER BY doc_id) AS id, sha256({o.canon('text')}) AS canonical_hash, 'example' AS model, '{_CREATED}' AS created, 64 AS signature_bytes, true AS valid FROM documents")
def sign_records(spark, sf_dir):
    """All documents as signed records; the signatures are checked here, as DuckDB has no Ed25519."""
    made = registry.register(_docs(spark, sf_dir), _SECRET, _CREATED, "example")
    told = registry.with_validity(made, ed25519.public_key(_SECRET))
    return told.select("id", "canonical_hash", "model", "created", F.length("signature").alias("signature_bytes"), F.col("signature_valid").alias("valid"))


@query()
def verify_passages(spark, sf_dir):
    """Benchmark passages are registered; suspects are the passages unchanged, with look-alikes, cut short, and foreign texts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    records = materialize(registry.register(items, _SECRET, _CREATED, "example"), "records")
    index = materialize(retrieval.embedded(retrieval.sentences(records.select(F.col("id").alias("doc_id"), text.canonicalize(F.col("text")).alias("canon")))), "index")
    own = records.select(F.col("id").alias("doc_id"), "text")
    kinds = [attacks.SWEEP[0], attacks.SWEEP[3], attacks.Attack("truncate 20 tokens", "truncate", "2", {"n": 20})]
    attacked = materialize(attacks.sweep(own, kinds), "attacked").select(F.xxhash64("attack", "doc_id").alias("doc_id"), F.col("attacked_text").alias("text"))
    foreign = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.xxhash64("conv_id", "turn").alias("doc_id"), "text")
    return registry.verify(attacked.unionByName(foreign), records, index, ed25519.public_key(_SECRET)).select("doc_id", "status", "record_id", "similarity", "signature_valid", "changed_fraction")


@query(
    f"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS word FROM w),
z AS (SELECT doc_id, max((length(word) > 2 AND {_unit("'0'", "doc_id::VARCHAR", "'zw'", "i::VARCHAR")} < 0.5)::INT) AS c FROM e GROUP BY doc_id),
h AS (SELECT doc_id, max(({_unit("'0'", "doc_id::VARCHAR", "'hg'", "i::VARCHAR")} < 0.3 AND len(list_filter(range(1, length(word) + 1), lambda k: contains('{_PLAIN}', substr(word, k, 1)))) > 0)::INT) AS c FROM e GROUP BY doc_id)
SELECT 'homoglyph p=0.3' AS attack, count(*) AS n, sum(c) AS changed FROM h UNION ALL SELECT 'zero_width p=0.5', count(*), sum(c) FROM z UNION ALL SELECT 'identity', count(*), 0 FROM documents"""
)
def attack_sweep_summary(spark, sf_dir):
    """How many documents each of three edits changes."""
    docs = _docs(spark, sf_dir)
    out = attacks.sweep(docs, [attacks.SWEEP[i] for i in (0, 2, 3)])
    joined = out.join(docs, "doc_id")
    return joined.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("attacked_text") != F.col("text")).cast("long")).alias("changed"))


def _model(spark, sf_dir):
    """Vocabulary and model of the conversations."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    tokens = ngrams.token_table(generate.training_documents(ngrams.canonical_docs(turns)))
    vocab = materialize(ngrams.vocabulary(tokens), "vocab")
    rows = materialize(ngrams.encode(tokens, vocab), "encoded")
    grams = ngrams.ngram_rows(rows)
    return vocab, generate.NGramModel.from_tables(vocab, ngrams.unigram_probs(rows, vocab), ngrams.bigram_counts(grams), ngrams.trigram_counts(grams))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query()
def generate_marked(spark, sf_dir):
    """Forty marked tokens after the first tokens of each benchmark passage."""
    vocab, model = _model(spark, sf_dir)
    tokens = _items(spark, sf_dir).select("doc_id", F.posexplode(F.slice(text.tokenize(F.col("text")), 1, 8)).alias("pos", "token"))
    prompts = ngrams.encode(tokens, vocab).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tok_id"))).alias("t")).select("doc_id", F.col("t.tok_id").alias("prompt"))
    return generate.generate(prompts.repartition(spark.sparkContext.defaultParallelism, "doc_id"), model, 40, EXAMPLE_KEY)


@query()
def transport_couplings(spark, sf_dir):
    """The coupling, its information and its status for the model's distribution after each token of each whole benchmark passage."""
    vocab, model = _model(spark, sf_dir)
    tokens = _items(spark, sf_dir).select("doc_id", text.tokenize(F.col("text")).alias("tokens"))
    return generate.couplings(tokens.repartition(spark.sparkContext.defaultParallelism, "doc_id"), model, EXAMPLE_KEY)


def _edited(spark, sf_dir, attack):
    return attacks.apply(_items(spark, sf_dir), attack, _model(spark, sf_dir)[1]).select("doc_id", "attacked_text", "meta")


@query()
def attack_rewrite(spark, sf_dir):
    return _edited(spark, sf_dir, attacks.SWEEP[5]).withColumn("meta", F.col("meta")["changed"])


@query()
def attack_insert(spark, sf_dir):
    return _edited(spark, sf_dir, attacks.SWEEP[8]).withColumn("meta", F.col("meta")["inserted"])


@query()
def attack_piggyback(spark, sf_dir):
    return _edited(spark, sf_dir, attacks.SWEEP[12]).withColumn("meta", F.col("meta")["k"])


@query()
def token_diff(spark, sf_dir):
    """Word diff of each benchmark passage with its rewritten form."""
    items = _items(spark, sf_dir)
    edited = attacks.apply(items, attacks.SWEEP[5], _model(spark, sf_dir)[1]).select("doc_id", text.canonicalize(F.col("attacked_text")).alias("suspect"))
    pairs = items.select("doc_id", text.canonicalize(F.col("text")).alias("original")).join(edited, "doc_id")
    return registry.with_diff(pairs).select("doc_id", F.size("diff").alias("spans"), F.round("changed_fraction", 9).alias("changed_fraction"))
