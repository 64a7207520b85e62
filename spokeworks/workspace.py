"""Intermediate tables in the shared folder named by `spark.checkpoint.dir`."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders of the open jobs with the application they belong to, innermost last; each thread has its own.
_open_jobs: ContextVar[tuple[tuple[str, str], ...]] = ContextVar("open_jobs", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir`, else a folder of the warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_uri(spark: SparkSession, root: str) -> str:
    """`root` as tasks address it: on Spark's default file system unless it names one."""
    if "://" not in root and not root.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        root = default.rstrip("/") + root
    return re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", root))


def application_folder(spark: SparkSession) -> str:
    """Everything one application writes lies under its id."""
    return f"{scratch_root(spark)}/spokeworks/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder, or in that of the thread's innermost open `job`."""
    here = application_folder(spark)
    own = [path for application, path in _open_jobs.get() if application == here]
    return f"{own[-1] if own else here}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, path: str | None = None) -> None:
    """Delete the application's intermediate tables, or those at `path`; frames that read them end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path or application_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def job(spark: SparkSession, label: str = "job") -> Iterator[str]:
    """Intermediate tables written in this block go when it ends: write the result inside."""
    path = scratch_path(spark, label)
    before = _open_jobs.get()
    _open_jobs.set((*before, (application_folder(spark), path)))
    try:
        yield path
    finally:
        _open_jobs.set(before)
        release(spark, path)


def scratch_table(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write `df` once and return the table read back.

    The copy is columnar, so later passes read only the columns they need, it
    outlives lost executors, and its size on disk gives Spark exact statistics
    for choosing a join. With `folder` the table replaces the one written there
    before; otherwise it gets a path of its own.
    """
    path = f"{folder}/{label}" if folder else scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
