"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Set while rows are written: the shuffle files of such a job go when it ends, as nothing reads them again.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that meet in one task when rows are spread by key.
ROWS_A_TASK = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the one the cluster names, else one already set, else (local master only) a new one."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    active = context.getCheckpointDir()
    if active:
        return active
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sidewise-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, purpose: str = "rows") -> DataFrame:
    """Store ``df`` as Parquet below the shared folder and continue from the stored rows (in no particular order).

    The stored columns have positional names, so any names will do, repeated ones included. The files go when the
    session ends.
    """
    return _store(df, shared_path(df.sparkSession, purpose))


def _store(df: DataFrame, path: str) -> DataFrame:
    with shuffles_released(df.sparkSession):
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


@contextmanager
def stored(df: DataFrame, purpose: str = "rows") -> Iterator[DataFrame]:
    """``cut`` for as long as the block lasts: the files go when it ends, so nothing that reads them may outlive it."""
    path = shared_path(df.sparkSession, purpose)
    try:
        yield _store(df, path)
    finally:
        target, system = _file_system(df.sparkSession, path)
        system.delete(target, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Store ``df`` and bring the rows of each key together, in as many partitions as the stored rows ask for.

    What a task sorts and groups then stays the same however large the table is, whatever the session's number of partitions.
    """
    return by_rows(cut(df, "spread"), *keys)


def by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of each key together, in as many partitions as the rows ask for; counts the rows, so for tables as they are stored."""
    return df.repartition(partitions_of(df, ROWS_A_TASK), *keys)


def partitions_of(df: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """As many partitions as the rows of a stored table ask for, with ``rows`` to each."""
    return max(-(-df.count() // rows), 1)


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, reachable by all executors and deleted when the session ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sidewise"
    target, system = _file_system(spark, folder)
    if not system.exists(target):
        system.mkdirs(target)
        system.deleteOnExit(target)
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
