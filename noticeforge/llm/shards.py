"""Vectors dealt to shards, and queries that stream past one index for each shard.

Rows and queries travel in one shuffle, a shard to a partition. Within it rows come
first, in the order of their ids and contents whatever order they arrived in; they
make the shard's index once, and all its queries then go by in batches. A task holds
one shard and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Most rows of a shard; smaller tables still have up to so many shards, of at least so many rows.
SHARD_ROWS, SHARDS, LEAST_ROWS = 262_144, 16, 16_384


def shard_count(n: int, least_rows: int = LEAST_ROWS) -> int:
    """Shards for n rows: depends on nothing but n, so that every cluster gives the same answers."""
    return max(1, -(-n // SHARD_ROWS), min(SHARDS, -(-n // least_rows)))


def vectors(df: DataFrame, id_col: str, vector_col: str, is_query: Column, usable: Callable[[Column], Column]) -> DataFrame:
    """id, v, key (the contents' hash), dim and asked of the rows that take part: those with an id and a usable vector."""
    if df.schema[id_col].dataType.simpleString() not in INTEGERS:
        raise TypeError(f"{id_col} must hold integers")
    v = F.col(vector_col)
    if df.schema[vector_col].dataType.elementType.simpleString() not in ("float", "double"):
        v = v.cast("array<double>")
    whole = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return whole.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "v", F.xxhash64("id", "v").alias("key"), F.size("v").alias("dim"), "asked")


def home(shards: int) -> Column:
    """The shard of a row."""
    return F.pmod("key", F.lit(shards)).cast("int")


def stream_past(rows: DataFrame, queries: DataFrame, shards: int, index: Callable, schema: str, least: str = "double") -> DataFrame:
    """What index(ids, vectors).search(ids, keys, vectors, bounds) yields of every shard for the queries that go there.

    rows have id, v, key, dim; queries have those, shard, and bound (null: none).
    Queries of another length than a shard's rows don't meet them. search yields
    record batches of the schema.
    """
    columns = ["shard", "dim", "kind", "id", "key", "bound", "v"]
    left = rows.select(home(shards).alias("shard"), "dim", F.lit(0).alias("kind"), "id", "key", F.lit(None).cast(least).alias("bound"), "v")
    right = queries.select("shard", "dim", F.lit(1).alias("kind"), "id", "key", F.col("bound").cast(least).alias("bound"), "v")
    dealt = left.select(columns).unionByName(right.select(columns)).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, made = None, [], None
        for batch in batches:
            marks = [batch.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for start, end in zip([0, *change], [*change, len(batch)]):
                part = batch.slice(start, end - start)
                at = (marks[0][start], marks[1][start])
                if at != group:
                    group, held, made = at, [], None
                if marks[2][start] == 0:
                    held.append((part.column(3).to_numpy(), matrix(part)))
                elif held or made:
                    if made is None:
                        made = index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                        held = []
                    yield from made.search(part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part), part.column(5).to_numpy(zero_copy_only=False))

    return common.map_arrow(dealt, run, schema)


def matrix(part: pa.RecordBatch) -> np.ndarray:
    flat = part.column(6).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(part), -1) if len(flat) else np.zeros((len(part), 0))
