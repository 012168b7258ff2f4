"""Intermediate tables in the shared folder named by `spark.checkpoint.dir`.

A stored table cuts lineage, is fixed once written (so partition numbers recorded in it stay
true) and survives the loss of executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_stored: list[str] = []
_scope = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for unset local sessions."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="flowtusk-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    getattr(_scope, "paths", _stored).append(path)
    return path


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread stores inside the block when it ends: use where results are
    written out inside, as in a micro-batch."""
    outer = getattr(_scope, "paths", None)
    _scope.paths = []
    try:
        yield
    finally:
        for path in _scope.paths:
            delete_path(spark, path)
        if outer is None:
            del _scope.paths
        else:
            _scope.paths = outer


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder written by this package, if it exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(target, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [entry.getPath().getName() for entry in found]


def drop_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call it when their results are consumed."""
    dropped = 0
    while _stored:
        dropped += delete_path(spark, _stored.pop())
    return dropped
