"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# AQE splits skewed join partitions and picks broadcast joins from measured sizes; the Arrow
# bounds keep a batch of whole documents inside a Python worker's memory.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
    # Longer generated methods are never compiled by the JVM; split per operator instead.
    METHOD_LIMIT: "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Recording a Python call site for every column costs more than planning these queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "trailmark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    root = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir`` for tables that cut lineage.

    Only a local session may go without that setting; it then gets a temporary folder, which goes
    with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/trailmark-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table's folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# Of whole pages a batch holds a worker's memory several times over; by default it is 10,000 rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the session. Rows are computed when the caller asks for them, so the bounds stay set."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Streams started inside the block have the limit on generated methods, whatever the session is set to.

    A stream takes the session's settings over when it starts, so those of the session can go back at once.
    """
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, DEFAULTS[METHOD_LIMIT])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT)
        else:
            spark.conf.set(METHOD_LIMIT, before)


@contextmanager
def staged(spark: SparkSession) -> Iterator[str]:
    """A path for a table that is needed only inside the block; it is deleted in any case."""
    path = shared_folder(spark)
    try:
        yield path
    finally:
        delete(spark, path)
