"""Scratch tables that cut a plan: written to the folder that all executors share, deleted when the session ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir; in local mode one of our own where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _folders[app] = f"{(top or 'file://' + tempfile.mkdtemp()).rstrip('/')}/plans-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _folders[app])
    return _folders[app]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The table as it is now, from files: what reads it doesn't compute it again, so its shuffle files go at once."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
