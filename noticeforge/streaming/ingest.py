"""Micro-batches: observations stream in and are merged and committed with the state.

Duplicates are found against the state, which has no time to live, so a late day is
never dropped for being late; coverage moves only past days that were read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeforge.engine import Engine


def fresh(batch: DataFrame) -> DataFrame:
    """Rows of a batch that say something of their own: of those that differ in seq alone, the one with the smallest.

    Items that are known stay, since a corrected notice changes its entity.
    """
    said = [c for c in batch.columns if c != "seq"]
    return batch.groupBy(*said).agg(F.min("seq").alias("seq")).select(*batch.columns)


def into(engine: Engine, clock: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """A sink that runs the engine over each batch, as over a table: the state is the same however the rows are cut into batches.

    A batch that is run again after its commit changes no entity and makes no event.
    """

    def run(batch: DataFrame, number: int) -> None:
        now = clock()
        rows = fresh(batch)
        if not rows.isEmpty():
            engine.run(rows, now.date(), now)

    return run


def stream(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int = 10) -> StreamingQuery:
    """Run sink on each batch of new parquet files until those that are there are used up."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and hour with a watermark, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
