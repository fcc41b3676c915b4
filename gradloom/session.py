"""Session helpers: the shared folder for checkpoints, and lineage cuts."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or groups, about; a larger table gets more tasks than the session's shuffle width.
TASK_ROWS = 1 << 19


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a local session may fall back to a temporary folder: on a cluster such a folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gradloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame, name: str, outlives: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` as a new Parquet table in the shared folder and read it back: the lineage cut for large tables.

    A table that `outlives` the `lifetime` it is written in belongs to the one around it. `options` are those of the Parquet writer.
    """
    path = shared_path(df.sparkSession, name, outlives)
    with shuffles_end(df.sparkSession):
        df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in the block go when each of them ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder; within a `lifetime` it is deleted at its end."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes()
    if scopes[:len(scopes) - outlives]:
        scopes[-1 - outlives].append(path)
    return path


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The lifetimes that are open in this thread, the innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables and files that were written into the shared folder inside it.

    The results that leave the block must have been computed in it, or be tables that outlive it (`stored(..., outlives=True)`):
    a DataFrame that still reads a deleted table fails.
    """
    own: list[str] = []
    _scopes().append(own)
    try:
        yield
    finally:
        _scopes().pop()
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors, once per session, as `--py-files` would."""
    context = spark.sparkContext
    if any(path.endswith("/gradloom.zip") for path in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="gradloom-"), "gradloom"), "zip", root, "gradloom")
    context.addPyFile(archive)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width.

    Rows that only describe work (byte ranges, weight chunks) must name it: by their tiny size adaptive execution would
    merge them into one task.
    """
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a sort or a grouping of so many rows: the memory of one does not grow with the table."""
    return max(shuffle_partitions(spark), math.ceil(rows / TASK_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
