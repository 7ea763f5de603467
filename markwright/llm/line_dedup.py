"""Line dedup over levelled sorted runs of line hashes.

The store is a list of runs, as in a log-structured merge tree.  A run is a bucketed table, sorted by
line hash in each bucket, with the number of documents and the largest doc_id that hold each line.
:meth:`LineRuns.add` takes a batch: its own hashes are counted and written in the same buckets, then merge-anti-joined with the
runs one by one, and what is left, the fresh lines, becomes a new run of level 0.  The rest, lines that some
run has, is kept beside it as counts.  Whenever a level has ``fanout`` runs they
are merged into one run of the next level, so each hash is rewritten once a level.  All runs share
their buckets, so joins and merges of runs move no rows.

All of it is DataFrame operations; no Python runs on executors.  A line's hash is two chained
64-bit hashes of its key.  Hot lines are pre-aggregated before they are shuffled.

Defined results: a null or empty text is one empty line; a document is a doc_id: a key counts once for it however often its rows
repeat the key, and rows that repeat a doc_id share their decision; rows with a null doc_id are no documents, so they do not
count, own nothing and lose the lines that others lose; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.session import materialize, shared_dir

MIN_CHARS = 40
MIN_DOCS = 5
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """Stripped and with A-Z in lower case; lines of ASCII alone take the faster way."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(line) == F.length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_hashes(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """``name``, a, b: the hashes of each row's distinct long keys."""
    long = F.filter(lines_of(F.col("text")), lambda line: F.length(line) >= MIN_CHARS)
    keys = F.array_distinct(F.filter(F.transform(long, line_key), lambda key: F.length(key) >= MIN_CHARS))
    return docs.select(name, F.explode(keys).alias("key")).select(name, _hash(F.col("key")).alias("h")).select(name, "h.a", "h.b")


class LineRuns:
    """Levelled runs with columns a, b, n_docs, owner, in ``buckets`` buckets."""

    def __init__(self, spark, fanout: int = 2, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        # as many as a shuffle has partitions: an aggregated batch then lies as the runs do
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.counts: list[DataFrame] = []
        self._tables: dict[str, str] = {}  # name: folder
        self._live: set[str] = set()

    def _write(self, rows: DataFrame) -> DataFrame:
        """A bucketed, sorted table in the shared folder, one file for each bucket."""
        name = f"markwright_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/markwright/{name}"
        rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(name)
        self._tables[name] = path
        table = self.spark.table(name)
        table._markwright_run = name
        return table

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, hashes: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, a, b) and return the new run: the lines that no earlier batch had."""
        counted = hashes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))
        if not self.runs():
            run = self._write(counted)
        else:
            batch = self._write(counted)
            run = self._write(self.fresh(batch))
            self.counts.append(self._write(batch.join(run.select(*_KEY), _KEY, "left_anti")))
            self._drop(batch)
            if len(self.counts) >= self.fanout:
                self.counts = [self._merged(self.counts)]
        self._push(run, 0)
        return run

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The merge anti-join: the rows of a batch that no run has."""
        for run in self.runs():
            batch = batch.join(run.select(*_KEY), _KEY, "left_anti")
        return batch

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._push(merged, level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return self._write(self._union(runs))

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        """One row for each hash of the runs: a merge join, bucket by bucket."""
        every = runs[0]
        for run in runs[1:]:
            other = run.select(*_KEY, F.col("n_docs").alias("_n"), F.col("owner").alias("_o"))
            both = every.join(other, _KEY, "full")
            every = both.select(*_KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("owner", "_o").alias("owner"))
        return every

    def totals(self) -> DataFrame | None:
        """One row for each hash over all runs and counts."""
        if not self.runs():
            return None
        return self._union([*self.runs(), *self.counts])

    def _drop(self, table: DataFrame) -> None:
        name = table._markwright_run
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._tables.pop(name))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def vacuum(self) -> None:
        """Delete the runs that have been merged; such runs handed out by :meth:`add` end here."""
        live = {run._markwright_run for run in [*self.runs(), *self.counts]}
        for name in [n for n in self._tables if n not in live]:
            table = self.spark.table(name)
            table._markwright_run = name
            self._drop(table)

    def clear(self) -> None:
        """Delete everything."""
        self.levels, self.counts = [], []
        self.vacuum()


def _once(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The hashes of rows with a doc_id, those of a doc_id that several rows share once only."""
    shared = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    named = hashes.where(F.col("doc_id").isNotNull())
    return named.join(shared, "doc_id", "left_anti").unionByName(named.join(shared, "doc_id", "left_semi").distinct())


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines with a key of at least 40 code points that at least ``min_docs`` documents hold are dropped from all
    documents but the one with the largest doc_id.
    """
    named = docs.select("doc_id", "text")
    hashes = materialize(line_hashes(named), "line-hashes")
    once = _once(named, hashes)
    store = LineRuns(docs.sparkSession)
    for i in range(batches):
        store.add(once.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
        store.vacuum()
    heavy = materialize(store.totals().where(F.col("n_docs") >= min_docs).select(*_KEY, "owner"), "heavy-lines")
    store.clear()
    drops = hashes.where(F.col("doc_id").isNotNull()).join(heavy, _KEY).where(F.col("doc_id") != F.col("owner"))
    drops = materialize(drops.groupBy("doc_id").agg(F.collect_set(F.struct(*_KEY)).alias("_drop")).withColumnRenamed("doc_id", "_doc"), "line-drops")
    drops = drops.hint("merge")  # they grow with the documents: one plan for all sizes
    # rows without a doc_id are told apart by their text
    nameless = materialize(line_hashes(docs.where(F.col("doc_id").isNull()).select(F.md5(F.encode("text", "UTF-8")).alias("_md5"), "text"), "_md5").distinct().join(heavy.select(*_KEY), _KEY), "nameless-lines")
    lost = nameless.groupBy("_md5").agg(F.collect_set(F.struct(*_KEY)).alias("_drop"))
    others = docs.where(F.col("doc_id").isNull()).withColumn("_doc", F.md5(F.encode("text", "UTF-8"))).join(lost, F.col("_doc") == F.col("_md5"), "left").drop("_md5", "_doc")
    joined = docs.where(F.col("doc_id").isNotNull()).join(drops, F.col("doc_id") == F.col("_doc"), "left").drop("_doc").unionByName(others)
    lines = lines_of(F.col("text"))
    gone = lambda line: (F.length(line) >= MIN_CHARS) & F.array_contains(F.col("_drop"), _hash(line_key(line)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda line: ~gone(line)))
    told = joined.withColumns({"_kept": kept, "n_lines": F.size(lines).cast("long")})
    return told.withColumns({"n_dropped": F.col("n_lines") - F.size("_kept"), "kept_text": F.array_join("_kept", "\n")}).drop("_kept", "_drop")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: Rows are numbered first, so that rows that share a doc_id, or have none, have a result each.
ORACLE_SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
told AS (
  SELECT x.rid, x.doc_id, x.pos, x.line, h.k IS NOT NULL AND x.doc_id IS DISTINCT FROM h.owner AS gone
  FROM keyed x LEFT JOIN heavy h ON x.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY rid, doc_id
"""
