"""Sources and sinks: text corpora, the record table, the sentence index, count tables and reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.functions import ed25519
from markwright.operators import registry


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text of the ``*.txt`` files under a folder, one row each, numbered in order of path."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return registry.assign_ids(named, ["path"]).withColumnRenamed("id", "doc_id")


def one_text(spark: SparkSession, body: str) -> DataFrame:
    return spark.createDataFrame([(0, body)], "doc_id long, text string")


def append_records(records: DataFrame, path: str) -> None:
    """Append to the record table, clustered by hash so that lookups skip files."""
    records.repartitionByRange("canonical_hash").sortWithinPartitions("canonical_hash").write.mode("append").parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(registry.RECORD).parquet(path)


def record(spark: SparkSession, path: str, id: int) -> DataFrame:
    """The record with an id, as a table of one row or none."""
    return records(spark, path).where(F.col("id") == id)


def last_id(spark: SparkSession, path: str) -> int:
    return records(spark, path).agg(F.max("id")).first()[0] or 0


def save_index(index: DataFrame, path: str, embedder: str = "hashing") -> None:
    """The sentence vectors, with the embedder's name in a column that Parquet stores once."""
    index.withColumn("embedder", F.lit(embedder)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, embedder: str = "hashing") -> DataFrame:
    """Refuses an index made by another embedder."""
    index = spark.read.parquet(path)
    other = index.where(F.col("embedder") != embedder).select("embedder").first()
    if other:
        raise ValueError(f"the index was made by embedder {other[0]!r}, not {embedder!r}")
    return index.drop("embedder")


def model_fingerprint(docs: DataFrame, vocab_size: int) -> str:
    """Depends on the contents of a corpus, not on file names or on the order of rows."""
    row = docs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "text")), F.sum(F.length("text").cast("long"))).first()
    return hashlib.sha256(json.dumps([*row, vocab_size]).encode()).hexdigest()[:16]


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def has_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> bool:
    """Whether all of them were written to the end."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS") for name in names]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_key(secret: bytes, path: str) -> None:
    target = Path(path)
    target.touch(mode=0o600)
    target.write_text(ed25519.private_pem(secret))


def load_key(path: str) -> bytes:
    return ed25519.read_private_pem(Path(path).read_text())


COLUMNS = (
    ("attack", "attack"), ("n", "n"), ("changed", "tokens_changed_frac"), ("TPR naive", "tpr_analytic_naive"), ("TPR", "tpr_analytic_hardened"), ("TPR emp.", "tpr_empirical_hardened"),
    ("AUC", "auc_hardened"), ("z naive", "mean_z_naive"), ("z", "mean_z_hardened"), ("recall@1", "retrieval_recall_at_1"), ("attributed", "stack_attributed"), ("IoU", "localization_mean_iou"),
)


def report_json(report: DataFrame, extra: dict | None = None) -> str:
    """The report (one row for each attack, so small) as one JSON document."""
    return json.dumps({**(extra or {}), "attacks": [json.loads(r) for r in report.orderBy("attack").toJSON().collect()]}, indent=2)


def report_markdown(report: DataFrame) -> str:
    def shown(x: object) -> str:
        return "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)

    head = ["| " + " | ".join(t for t, _ in COLUMNS) + " |", "|" + "---|" * len(COLUMNS)]
    return "\n".join([*head, *("| " + " | ".join(shown(r[c]) for _, c in COLUMNS) + " |" for r in report.orderBy("attack").collect())]) + "\n"


def insert_table(document: str, table: str, start: str = "<!-- results -->", end: str = "<!-- /results -->") -> str:
    """A document with the text between two markers replaced."""
    before, _, rest = document.partition(start)
    _, _, after = rest.partition(end)
    return f"{before}{start}\n{table}{end}{after}"
