"""Session helper and shared-storage helper."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_session(app: str = "markwright", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect.

    Adaptive execution stays on (skewed joins are split, small shuffles coalesced) and the
    session time zone is UTC.  Keyword arguments override settings (dots as double underscores).
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder and any other session a folder in
    the warehouse; the choice is kept in the session so that all operators agree.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("markwright.shared.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="markwright-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_markwright"
        spark.conf.set("markwright.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/markwright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes.

    A batch holds whole texts, in the JVM's direct memory and again in the worker; the defaults are made for narrow
    rows.  Lower settings of the session are kept.  The settings are read when a plan runs, after the operator has returned
    it, so they stay in the session.
    """
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    told = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES).replace("-1", "0"))
    if not 0 < told <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a context, for clusters on which it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_markwright_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="markwright-")) / "markwright_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._markwright_shipped = True
