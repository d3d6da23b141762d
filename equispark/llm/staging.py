"""Tables written once to the shared scratch folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from equispark.session import checkpoint_dir


# Set by a write alone, whose plan nothing runs again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scopes: ContextVar[tuple[list[tuple], ...]] = ContextVar("scopes", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, removed when the driver ends."""
    return _fresh(spark, name)[0]


def _fresh(spark: SparkSession, name: str) -> tuple:
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target)
    return path, files, target


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are removed at its end; `lasting` ones belong to the scope around it, if there is one.

    A frame that is returned from inside may read lasting tables only. Also
    decorates functions.
    """
    tables: list[tuple] = []
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield
    finally:
        _scopes.reset(token)
        for files, target in tables:
            files.delete(target, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows in what is written inside; they count beside the JVM's heap and in the workers."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def staged(frame: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The frame as a written table: its plan is cut, its shuffles are gone, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path, files, target = _fresh(spark, name)
    scopes = _scopes.get()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append((files, target))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
