"""A data source for paged JSON services: format("paged_json").

Options: client (module:function, called as client(start, stop, page, size) and
returning a dict with total_hits and results), start, stop (dates), window_days,
page_size, source. One partition for each window; a task checks every page: hits
must stay the same, ids are taken once, a page without news or too many pages end
the read with an error rather than with less.

- Conditions on day that reach the source narrow the days that it asks for; Spark
  applies them to the rows as well. least_days is the shortest window that the
  service accepts: shorter ones are widened, and rows outside are dropped.
- pages_per_task: the first answer of each window is read at planning, and its pages
  are dealt to tasks of so many. A total that changed since is an error.
- evidence = true: a partition's last row says what was read (kind "evidence"), and
  one that fails says so instead of failing the read. data() and coverage() split
  the table, so that checkpoints follow what was read.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Pages of a window at most, and bounds of a page's size. Fixed values.
MOST_PAGES, LEAST_SIZE, MOST_SIZE = 1000, 1, 100
EVIDENCE = "start date, stop date, first int, pages int, hits long, rows long, error string"


class Part(InputPartition):
    """Days asked for, days wanted, and the pages to read: all of them (last is None), or some of a total."""

    def __init__(self, start: str, stop: str, low: str, high: str, first: int = 0, last: int | None = None, total: int | None = None, error: str = "") -> None:
        self.start, self.stop, self.low, self.high, self.first, self.last, self.total, self.error = start, stop, low, high, first, last, total, error


def windows(start: date, stop: date, days: int) -> Iterator[tuple[date, date]]:
    while start <= stop:
        last = min(start + timedelta(days - 1), stop)
        yield start, last
        start = last + timedelta(1)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.size = min(MOST_SIZE, max(LEAST_SIZE, int(options.get("page_size", 50))))
        self.start, self.stop = date.fromisoformat(options["start"]), date.fromisoformat(options["stop"])
        self.with_evidence = options.get("evidence", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the days; every condition goes back to Spark, as a service may answer with more."""
        for f in filters:
            on, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            # Without its evidence rows a narrowed read would say nothing about the days left out.
            if on == ("day",) and isinstance(value, date) and not self.with_evidence:
                low = {GreaterThan: 1, GreaterThanOrEqual: 0, EqualTo: 0}.get(type(f))
                high = {LessThan: 1, LessThanOrEqual: 0, EqualTo: 0}.get(type(f))
                self.start = self.start if low is None else max(self.start, value + timedelta(low))
                self.stop = self.stop if high is None else min(self.stop, value - timedelta(high))
            yield f

    def _client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)

    def _page(self, part: Part, page: int) -> dict:
        answer = self._client()(part.start, part.stop, page, self.size)
        if not isinstance(answer, dict) or not isinstance(answer.get("results"), list) or not isinstance(answer.get("total_hits"), int):
            raise ValueError("a page without results or total_hits")
        return answer

    def partitions(self) -> list[Part]:
        days, least = int(self.options.get("window_days", 10)), int(self.options.get("least_days", 1))
        parts = []
        for low, high in windows(self.start, self.stop, max(days, least)):
            wide = min(low, high - timedelta(least - 1))
            parts.append(Part(wide.isoformat(), high.isoformat(), low.isoformat(), high.isoformat()))
        each = int(self.options.get("pages_per_task", 0))
        return [x for p in parts for x in self._dealt(p, each)] if each else parts

    def _dealt(self, part: Part, each: int) -> list[Part]:
        try:
            total = self._page(part, 0)["total_hits"]
        except Exception as e:
            if not self.with_evidence:
                raise
            return [Part(part.start, part.stop, part.low, part.high, error=f"{type(e).__name__}: {e}")]
        pages = min(MOST_PAGES, -(-total // self.size)) or 1
        return [Part(part.start, part.stop, part.low, part.high, a, min(a + each, pages), total) for a in range(0, pages, each)]

    def read(self, partition: Part) -> Iterator[tuple]:
        said = {"start": partition.low, "stop": partition.high, "first": partition.first, "pages": 0, "hits": None, "rows": 0, "error": None}
        source = self.options.get("source", "")
        try:
            for x, day in self._rows(partition, said):
                if partition.low <= day.isoformat() <= partition.high:
                    said["rows"] += 1
                    yield ("data", source, str(x["id"]), day, json.dumps(x, ensure_ascii=False, sort_keys=True))
        except Exception as e:
            if not self.with_evidence:
                raise
            said["error"] = f"{type(e).__name__}: {e}"
        if self.with_evidence:
            yield ("evidence", source, None, date.fromisoformat(partition.high), json.dumps(said))

    def _rows(self, part: Part, said: dict) -> Iterator[tuple[dict, date]]:
        if part.error:
            raise ValueError(part.error)
        seen: set = set()
        total, last = part.total, MOST_PAGES if part.last is None else part.last
        for page in range(part.first, last):
            answer = self._page(part, page)
            if total is not None and answer["total_hits"] != total:
                raise ValueError("total_hits changed between pages")
            total, before = answer["total_hits"], len(seen)
            said |= {"pages": said["pages"] + 1, "hits": total}
            for x in answer["results"]:
                if x.get("id") in (None, "") or not x.get("date"):
                    raise ValueError("a record without id or date")
                if x["id"] not in seen:
                    seen.add(x["id"])
                    yield x, date.fromisoformat(str(x["date"])[:10])
            if part.last is None and len(seen) >= total:
                return
            if len(seen) == before and total:
                raise ValueError("a page without anything new")
        if part.last is None:
            raise ValueError("too many pages")


def data(read: DataFrame) -> DataFrame:
    """The records of a read with evidence, each id once: pages that other tasks read may repeat one. Write the read once before it is split."""
    w = Window.partitionBy("source", "external_id").orderBy("day", "raw")
    return read.where("kind = 'data'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "kind")


def coverage(read: DataFrame) -> DataFrame:
    """source, covered_through, failed and warning of a read with evidence, as Engine.run takes them: the day before the first window that failed or gave fewer records than its hits."""
    said = read.where("kind = 'evidence'").select("source", F.from_json("raw", EVIDENCE).alias("e")).select("source", "e.*")
    own = read.where("kind = 'data'").groupBy("source", "day").agg(F.count_distinct("external_id").alias("n"))
    parts = said.groupBy("source", "start", "stop").agg(F.max("hits").alias("hits"), F.max("error").alias("error"))
    met = parts.join(own, (own["source"] == parts["source"]) & F.col("day").between(F.col("start"), F.col("stop")), "left").groupBy(parts["source"], "start", "stop", "hits", "error").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    bad = F.coalesce("error", F.when(F.col("n") < F.col("hits"), F.concat(F.col("n"), F.lit(" records of "), "hits")))
    judged = met.withColumn("bad", bad)
    first = F.min(F.when(F.col("bad").isNotNull(), F.struct("start", "bad")))
    out = judged.groupBy("source").agg(F.max("stop").alias("last"), first.alias("first"))
    return out.select("source", F.when(F.col("first").isNull(), F.col("last")).alias("covered_through"), F.col("first.start").alias("failed"), F.coalesce("first.bad", F.lit("")).alias("warning"))


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "kind string, source string, external_id string, day date, raw string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
