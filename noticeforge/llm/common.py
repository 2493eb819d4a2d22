"""Helpers that the training-data operators share: tables, scratch tables, byte-bounded batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.operators import scratch

ROOT = Path(__file__).resolve().parents[2]

#: Code points that end a word: space, and U+0009 to U+000D. Fixed by the queries' contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Most bytes of text that a Python operator turns into arrays at once.
BATCH_BYTES = 1 << 20
#: Most bytes of an Arrow batch on its way to or from Python, for sessions that leave Spark's default.
ARROW_BYTES, ARROW_CONF, ARROW_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share folders and Python's path."""
    return spark.sparkContext.master.partition("[")[0] == "local"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound the Arrow batches that they get."""
    if spark.conf.get(ARROW_CONF, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_CONF, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    seen = str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == ROOT
    if app in _shipped or (seen and is_local(spark)):
        return
    to = Path(tempfile.mkdtemp()) / "noticeforge.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted((ROOT / "noticeforge").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def give_back() -> None:
    """Return memory that this worker holds but doesn't use, as it will run other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


_base: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir; in local mode a folder of our own where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _base:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top and not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = top or Path(tempfile.mkdtemp(prefix="noticeforge-")).as_uri()
        _base[app] = f"{top.rstrip('/')}/noticeforge-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _base[app])
    return _base[app]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, lost executors cost only what reads it, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with scratch.shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/noticeforge-" in f:
                _delete(df.sparkSession, f)


def byte_slices(batch: pa.RecordBatch, column: int = 0, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes in a string column, or one row."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def rows(batches: Iterable[pa.RecordBatch], column: int = 0, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        yield from byte_slices(batch, column, most)


def word_count(text) -> F.Column:
    """Number of WORD_PATTERN matches; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def canonical_row_order(df: DataFrame) -> list:
    """Columns that order rows the same way on every run, whatever the partitions."""
    return [F.col(c) for c in df.columns]
