"""Intermediate tables in the shared folder that the cluster names.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: any executor can read it again after another one
is lost. Where the setting is empty, a session on a local master (tests) gets a folder of the driver; on a cluster, where
executors don't share that folder, the setting is asked for.

What an operator writes belongs to its :func:`scope` and is deleted when that ends, but for what it hands on. Shuffle
files of a write go when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import logging
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Deletes a write's shuffle files as it ends (Spark 4.1 and later; elsewhere an unknown setting, which is harmless).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_scope: contextvars.ContextVar[list[tuple[SparkSession, str]]] = contextvars.ContextVar("tidegrid_scope", default=_written)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's setting, else the context's checkpoint folder, else (local masters) a new one."""
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not at:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jdir.get() if jdir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{KEY} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set(KEY, at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of an Arrow batch for the session: texts and sets may be long, and a batch is held in memory whole."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def temporary(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder. The folder goes with the scope."""
    path = f"{shared_dir(spark)}/tidegrid/{label}-{uuid.uuid4().hex}"
    _scope.get().append((spark, path))
    return path


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and reads it back with the same schema. The table goes with the scope that it is written in."""
    spark = df.sparkSession
    path = temporary(spark, label)
    with _setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """The tables that are written inside a :func:`scope`."""

    def __init__(self, outer: list[tuple[SparkSession, str]]):
        self.outer, self.own = outer, []

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """As :func:`persisted`, for a table that outlives the scope (it goes with the one outside)."""
        token = _scope.set(self.outer)
        try:
            return persisted(df, label)
        finally:
            _scope.reset(token)

    def drop(self, but: int = 0) -> None:
        """Deletes what has been written so far, but for the last ``but`` tables. Nothing that reads it may be used after."""
        gone = self.own[: len(self.own) - but]
        del self.own[: len(gone)]
        _drop(gone)


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Tables that :func:`persisted` writes inside are deleted at the end."""
    here = Scope(_scope.get())
    token = _scope.set(here.own)
    try:
        yield here
    finally:
        _scope.reset(token)
        here.drop()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in a store that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            delete(spark, path)
        except Exception as e:
            if spark.sparkContext._jsc is None:  # the context has ended: the folder's owner cleans up
                continue
            logging.getLogger("tidegrid").warning("%s was not deleted: %s", path, type(e).__name__)


@atexit.register
def drop_all() -> None:
    """Deletes what this driver has written outside of any scope."""
    _drop(_written)
