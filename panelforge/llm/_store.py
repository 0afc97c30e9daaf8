"""Written tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a local session (tests) gets a folder of its own; on
    a cluster that is an error, since its machines don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="panelforge-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


_OWN: dict[str, str] = {}


def _application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/panelforge-{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KNOWN.add(folder)
    return folder


_KNOWN: set[str] = set()
_WRITTEN = threading.local()


#: For folders of the file: scheme alone: no checksum files beside the tables, each of which would start processes.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a file, files, and rows at most where a table's size is known to be small.
FILE_ROWS, FILES, SMALL_ROWS = 2_000, 64, 1_000_000


def durable(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its lineage ends there and
    every later reader sees the same rows, whatever executors are lost.  ``rows``: how many it has at most, if that is
    known: a small table goes through a shuffle to few files, and the tasks that make it stay as many as they are."""
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None and rows <= SMALL_ROWS:
        df = df.repartition(min(FILES, rows // FILE_ROWS + 1))
    df.write.options(**_PLAIN_FILES).parquet(path)
    if (paths := getattr(_WRITTEN, "paths", None)) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """``durable(make(), name)``, less the tables that ``make`` wrote on the way; nothing else may read those."""
    before = getattr(_WRITTEN, "paths", None)
    _WRITTEN.paths = []
    try:
        out = durable(make(), name)
        *passing, last = _WRITTEN.paths
    finally:
        _WRITTEN.paths = before
    for path in passing:
        _delete(spark, path)
    if before is not None:
        before.append(last)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote; their readers must be done."""
    folder = _application_folder(spark)
    _delete(spark, folder)
    _KNOWN.discard(folder)


#: The most that one Arrow batch between the JVM and a Python worker holds.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at BATCH_BYTES or less from now on: both sides hold several at once, so with
    the default of 64 MB a task of long rows takes hundreds of MB outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
