"""Hydration as a lookup join: pages that notices point at are asked for once, and stay as a table.

Only addresses that pass the caller's filter and aren't in the table are asked for,
each once. They are dealt by host, and hosts to at most so many tasks each, so that no
host gets more requests at a time; answers and errors are rows, which the caller
writes and adds to the table.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "url string, body string, error string"
#: Bytes of answers that a task holds before it passes them on.
BATCH_BYTES = 1 << 22


def missing(notices: DataFrame, pages: DataFrame, wanted: Column, url_col: str = "url") -> DataFrame:
    """url and host of what is wanted, each once, and isn't in pages; addresses without a host are left out."""
    asked = notices.where(wanted).select(F.col(url_col).alias("url")).distinct()
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return asked.withColumn("host", host).where("host IS NOT NULL").join(pages.select("url"), "url", "left_anti")


def fetch(asked: DataFrame, client: str, per_host: int = 1, tasks: int = 64) -> DataFrame:
    """PAGE rows of asked (url, host). client is module:function, called with an address and returning its text; what it raises is the row's error.

    A task takes its addresses one after the other, host by host; a host's addresses go to at most per_host tasks.
    """
    lane = F.pmod(F.xxhash64("url"), F.lit(per_host))
    dealt = asked.withColumn("lane", lane).repartition(tasks, "host", "lane").sortWithinPartitions("host", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = client.partition(":")
        ask = getattr(importlib.import_module(module), name)
        schema = pa.schema([("url", pa.string()), ("body", pa.string()), ("error", pa.string())])
        for batch in batches:
            held, size = [], 0
            for url in batch.column(0).to_pylist():
                try:
                    held.append((url, ask(url), None))
                except Exception as e:
                    held.append((url, None, f"{type(e).__name__}: {e}"))
                size += len(held[-1][1] or "")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return dealt.select("url").mapInArrow(run, PAGE)


def hydrated(notices: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """notices with body and error of their page; null where it wasn't asked for."""
    own = pages.select(F.col("url").alias("_url"), "body", "error")
    return notices.join(own, notices[url_col] == F.col("_url"), "left").drop("_url")


def routed(routes: list[DataFrame]) -> DataFrame:
    """One answer for each address from several routes' PAGE tables, the first route that has it first: url, body, route (from 0), failures (of the routes before it).

    An empty text is an answer; only an error sends an address on to the next route.
    """
    rows = None
    for i, df in enumerate(routes):
        own = df.select("url", F.lit(i).alias("route"), "body", "error")
        rows = own if rows is None else rows.unionByName(own)
    answered = F.when(F.col("error").isNull(), F.col("route"))
    out = rows.groupBy("url").agg(F.min_by("body", answered).alias("body"), F.min(answered).alias("route"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("route", "error")))).alias("_bad"))
    before = F.filter("_bad", lambda x: F.col("route").isNull() | (x["route"] < F.col("route")))
    return out.select("url", "body", "route", F.transform(before, lambda x: x["error"]).alias("failures"))
