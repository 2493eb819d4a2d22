"""Catalogue, run reports and lists: denormalised views over the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import rules


def category(include: Column, applicable: Column, confirmed: Column, status: Column, excluded: Column) -> Column:
    """OPEN, REVIEW or TRACKING; advanced statuses and what is excluded, and only shown as it is followed, are tracked."""
    return (
        F.when(status.isin(*rules.ADVANCED_STATUSES) | excluded, "TRACKING")
        .when(include & applicable, "OPEN")
        .when(applicable | ~F.coalesce(confirmed, F.lit(False)), "REVIEW")
        .otherwise("TRACKING")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page(df: DataFrame, key: str, number: int, size: int = 5) -> DataFrame:
    """A page of rows ordered by key, with the number of pages; a number out of bounds is led to the nearest page."""
    last = max(1, -(-df.count() // size))
    at = min(max(number, 1), last)
    return df.orderBy(key).offset((at - 1) * size).limit(size).withColumns({"page": F.lit(at).cast("long"), "pages": F.lit(last).cast("long")})


def source_status(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The latest run of each source with its checkpoint."""
    last = runs.groupBy("source").agg(F.max_by(F.struct("id", "status", "found"), "id").alias("x")).select("source", "x.*")
    return last.join(checkpoints, "source", "left").orderBy("source")


def status_counts(df: DataFrame, prefix: str, *more: Column) -> DataFrame:
    """key (prefix and status) and n of each status, with further aggregates."""
    return df.groupBy(F.concat(F.lit(f"{prefix}_"), F.lower("status")).alias("key")).agg(F.count("*").alias("n"), *more)


def folder_groups(docs: DataFrame) -> DataFrame:
    """One row for each folder (folder.id): the newest document's id and title, how many there are, the texts, newest first, and the distinct links, in the order in which they first came.

    docs has id, published, folder (a struct of id and title), text and links (an array). Documents of a day go by id.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("published").alias("at"), "id", "text", "links")))
    out = docs.where("folder is not null").groupBy(F.col("folder.id").alias("folder_id")).agg(F.max_by("folder.title", F.struct("published", "id")).alias("title"), F.count("*").alias("documents"), rows.alias("rows"))
    newest = F.reverse(F.col("rows"))
    return out.select("folder_id", "title", "documents", F.element_at("rows", -1)["id"].alias("newest"), F.array_join(F.transform(newest, lambda r: r["text"]), "\n").alias("text"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["links"]))).alias("links"))


def link_union(links: DataFrame) -> DataFrame:
    """One row for each entity and url, the last one by seq, in the order in which urls first came. links has process_id, seq, url and label."""
    last = links.groupBy("process_id", "url").agg(F.min("seq").alias("first"), F.max_by("label", "seq").alias("label"))
    return last.select("process_id", "url", "label", F.row_number().over(Window.partitionBy("process_id").orderBy("first")).alias("place"))


def newest_milestone(links: DataFrame, day: Column) -> DataFrame:
    """Of each entity, the link whose label has the latest day (a column; empty if it has none); of equal ones the first."""
    dated = links.withColumn("day", day).where("day <> ''")
    return dated.groupBy("process_id").agg(F.max_by(F.struct("url", "label", "day"), F.struct("day", -F.col("place"))).alias("x")).select("process_id", "x.*")


def alias_groups(processes: DataFrame, aliases: DataFrame) -> DataFrame:
    """id of canonical entities with their aliases, and the latest last_seen and last_changed of the whole group."""
    led = processes.join(aliases.select(F.col("alias_id").alias("id"), F.col("process_id").alias("_to")), "id", "left")
    rows = led.groupBy(F.coalesce("_to", "id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("_to").isNotNull(), F.col("id")))).alias("aliases"), F.max("last_seen").alias("last_seen"), F.max("last_changed").alias("last_changed"))
    return rows


def run_states(runs: DataFrame) -> DataFrame:
    """Of each source: the newest run, and the newest that started, that ended and that ended well, by id."""
    pick = lambda cond: F.max(F.when(cond, F.col("id")))
    return runs.groupBy("source").agg(F.max("id").alias("newest"), pick(F.col("finished_at").isNotNull()).alias("completed"), pick(F.col("status") == "OK").alias("succeeded"), pick(F.col("finished_at").isNull()).alias("active"))


def folder_aliases(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """alias_id and process_id of documents that share a folder: all stand for the folder's owner, else for the one seen first.

    docs has id, folder_id and first_seen; owners has folder_id and id.
    """
    first = docs.groupBy("folder_id").agg(F.min_by("id", F.struct("first_seen", "id")).alias("oldest"))
    own = first.join(owners.select("folder_id", F.col("id").alias("owner")), "folder_id", "left").select("folder_id", F.coalesce("owner", "oldest").alias("process_id"))
    return docs.join(own, "folder_id").where(F.col("id") != F.col("process_id")).select(F.col("id").alias("alias_id"), "process_id")


def followed_items(items: DataFrame, followed: DataFrame) -> DataFrame:
    """source and external_id of items whose own entity is followed, for readers that treat them apart."""
    return items.join(followed.select("process_id"), "process_id", "left_semi").select("source", "external_id").distinct()


def newest_first(df: DataFrame, keys: list[str], day: Column, position: Column) -> DataFrame:
    """df with place: within keys, newest first; those of a day stay in the order of their positions, those without a day come last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(day), position)))


def records(processes: DataFrame, urls: DataFrame) -> DataFrame:
    """Entities as the notices they were: with source (of the first address; else "database"), external_id (the entity's), links in the order in which they came, and of what isn't a field the provisional mark alone.

    urls has process_id, source, url, label and first_seen.
    """
    links = F.array_sort(F.collect_list(F.struct("first_seen", "source", "url", "label")))
    own = urls.groupBy(F.col("process_id").alias("id")).agg(links.alias("links"))
    out = processes.drop("source").join(own, "id", "left").withColumn("links", F.coalesce("links", F.array().cast(own.schema["links"].dataType)))
    out = out.withColumns({"source": F.coalesce(F.get("links", F.lit(0))["source"], F.lit("database")), "external_id": F.col("id"), "exam_date_provisional": F.get_json_object("snapshot", "$.exam_date_provisional").cast("boolean")})
    return out.withColumn("links", F.transform("links", lambda x: x.dropFields("first_seen"))).drop("snapshot", "semantic_hash")


def outcome(attempted: Column, errors: Column, warnings: Column) -> Column:
    return F.when(attempted == 0, "MISSING").when(errors >= attempted, "NO_SOURCES").when((errors > 0) | (warnings > 0), "PARTIAL").otherwise("OK")


def healthy(attempted: Column, errors: Column, warnings: Column) -> Column:
    return attempted - errors - warnings


def carry(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The latest value that isn't null, from the start of the key's rows to the current one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def body_end(df: DataFrame, keys: list[str], position: str, length: Column, name: str = "stop") -> DataFrame:
    """Where a part ends: at the next part's position, the last one at the whole length."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn(name, F.coalesce(F.lead(position).over(w), length))


def windows(start: Column, stop: Column, days: int) -> Column:
    """Consecutive date windows of at most so many days, as an array of (start, stop)."""
    firsts = F.sequence(start, stop, F.make_dt_interval(days=F.lit(days)))
    return F.transform(firsts, lambda s: F.struct(s.cast("date").alias("start"), F.least(F.date_add(s.cast("date"), days - 1), stop).alias("stop")))


def coverage(covered: Column, warning: Column, failed: Column, today: Column) -> Column:
    """Struct (covered_through, status): days after the first failure stay uncovered; warnings without evidence cover nothing."""
    own = F.when(covered.isNotNull(), F.least(covered, today)).when(warning == "", today)
    own = F.when(failed.isNotNull(), F.least(F.coalesce(own, today), F.date_sub(failed, 1))).otherwise(own)
    partial = (warning != "") | F.coalesce(own < today, F.lit(True))
    return F.struct(own.alias("covered_through"), F.when(partial, "PARTIAL").otherwise("OK").alias("status"))


def lookback(checkpoint: Column, today: Column, overlap: int, first: int, most: int) -> Column:
    """Struct (days, gap): from the checkpoint to today, and overlap; capped, with the days beyond the cap."""
    asked = F.when(checkpoint.isNull(), first).otherwise(F.greatest(F.datediff(today, checkpoint), F.lit(0)) + overlap)
    return F.struct(F.least(asked, F.lit(most)).alias("days"), F.greatest(asked - most, F.lit(0)).alias("gap"))
