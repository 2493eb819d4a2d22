"""The ordered fold of notices into entities, as windows: what an entity is after each of its notices, and what its events become.

Every merge rule is a running aggregate over an entity's rows in order (the first or
last value that counts, the greatest, the best since a status was left), so a long
history needs no loop and no array: rows are sorted once by entity and stream by.
Only entities that a run touches take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import identity, rules
from noticeforge.operators import merge

#: Order of an entity's state before the run.
BEFORE = -1
#: Columns that stay as the first row has them, and those of a merged entity beside the snapshot's.
FIXED = ("canonical_key", "title_signature", "source")
RUNNING = ("title", "organisation", "locality", "province", "scope", "group", "qualification", "summary", "exam_place", "positions", "publication_date", "deadline", "deadline_confirmed", "exam_date", "provisional", "exam_time", "access", "compatibility", "status", "priority", "special_process")


def _so_far(*keys: str) -> Window:
    return Window.partitionBy("entity", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _last(value: Column, when: Column, over) -> Column:
    """The value of the last row so far for which the condition holds; null values count."""
    return F.last(F.when(when, F.struct(value.alias("v"))), ignorenulls=True).over(over)["v"]


def running(rows: DataFrame) -> DataFrame:
    """rows (entity, seq, RUNNING, FIXED, structured, others) with RUNNING as merged up to each row.

    The rules are those of merge.merged(), applied one row after the other. A
    provisional mark goes with the exam date that it came with. Equal seq within an
    entity aren't allowed.
    """
    w = _so_far()
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    has = lambda c: F.col(c).isNotNull()
    strict = F.coalesce("structured", F.lit(False))
    exceptional = F.coalesce(F.col("status").isin(*rules.EXCEPTIONAL_STATUSES), F.lit(False))
    df = rows.withColumns({"_part": F.sum(strict.cast("int")).over(w), "_turn": F.sum(exceptional.cast("int")).over(w)})
    leaves = (F.col("_turn") > 0) & ~exceptional & F.coalesce(F.col("status").isin(*rules.LEAVING_STATUSES), F.lit(False))
    df = df.withColumn("_left", F.coalesce(F.max(leaves.cast("int")).over(_so_far("_turn")), F.lit(0)))
    best = F.max(F.struct(merge.status_rank(F.col("status")).alias("rank"), "seq", "status")).over(_so_far("_turn", "_left"))["status"]
    out = {
        "title": F.coalesce(F.first(blank("title"), ignorenulls=True).over(w), F.last("title", ignorenulls=True).over(w)),
        "organisation": F.coalesce(F.first(blank("organisation"), ignorenulls=True).over(_so_far("_part")), F.last("organisation", ignorenulls=True).over(_so_far("_part"))),
        "access": F.coalesce(_last(F.col("access"), F.col("access") != rules.UNKNOWN_ACCESS, w), F.first("access").over(w)),
        "compatibility": F.coalesce(F.last(F.when(F.col("compatibility") != rules.REVIEW, F.col("compatibility")), ignorenulls=True).over(w), F.first("compatibility").over(w)),
        "status": F.when((F.col("_turn") > 0) & (F.col("_left") == 0), F.first("status").over(_so_far("_turn"))).otherwise(best),
        "priority": F.max("priority").over(w),
        "special_process": F.coalesce(F.last(blank("special_process"), ignorenulls=True).over(w), F.first("special_process").over(w)),
        "exam_time": F.last("exam_time", ignorenulls=True).over(w),
        "exam_date": _last(F.col("exam_date"), has("exam_date"), w),
        "provisional": _last(F.col("provisional"), has("exam_date"), w),
        "deadline": _last(F.col("deadline"), has("deadline") | strict, w),
        "deadline_confirmed": F.coalesce(F.last(F.when(has("deadline") | strict, F.struct(F.col("deadline_confirmed").alias("v"))), ignorenulls=True).over(w), F.first(F.struct(F.col("deadline_confirmed").alias("v"))).over(w))["v"],
    }
    out |= {c: F.coalesce(F.last(blank(c), ignorenulls=True).over(w), F.first(c, ignorenulls=True).over(w)) for c in ("locality", "province", "scope", "group", "qualification", "summary", "exam_place")}
    out |= {c: _last(F.col(c), has(c) | strict, w) for c in ("positions", "publication_date")}
    out |= {c: F.first(c).over(w) for c in FIXED}
    return df.withColumns(out).drop("_part", "_turn", "_left")


def changes(merged: DataFrame) -> DataFrame:
    """merged (of running(), with stored: the snapshot kept before the run) with snapshot, was, is_new, is_changed, labels and details.

    The row before the run, if there is one, has the stored snapshot and isn't in the result.
    """
    order = Window.partitionBy("entity").orderBy("seq")
    columns = {k: F.col(k) for k in identity.SNAPSHOT}
    own = F.when(F.col("seq") == BEFORE, F.col("stored")).otherwise(identity.snapshot(columns, F.col("provisional")))
    df = merged.withColumn("snapshot", own).withColumn("was", F.lag("snapshot").over(order)).where(F.col("seq") != BEFORE)
    df = df.withColumns({"is_new": F.col("was").isNull(), "is_changed": ~F.col("snapshot").eqNullSafe(F.col("was"))})
    was, now = ({k: F.get_json_object(c, f"$.{k}") for k in (*identity.SNAPSHOT, "exam_date_provisional")} for c in ("was", "snapshot"))
    # A snapshot without the mark says nothing about it.
    was["exam_date_provisional"] = F.when(now["exam_date_provisional"].isNotNull(), was["exam_date_provisional"])
    moved = F.col("is_changed") & ~F.col("is_new")
    none = F.array().cast("array<string>")
    df = df.withColumn("labels", F.when(F.col("is_new"), none).when(F.col("is_changed"), identity.changed_fields(was, now)).otherwise(F.array_compact(F.array("notice"))))
    said = identity.change_details(was, now, F.col("url"), F.col("said_by"), F.col("observed_at"))
    return df.withColumn("details", F.when(moved, said).otherwise(F.array().cast(merge.DETAILS)))


def actions(changed: DataFrame) -> DataFrame:
    """changed (of changes(), with included, notify, new_item, notice, ever_sent, had_initial, had_update) with action and target.

    Of an entity's events one may be a pending announcement and one a pending update.
    An announcement, once suppressed, doesn't come back in the run; an update, once
    made, stays. So whether each is there before a row follows from the rows before.
    """
    before = Window.partitionBy("entity").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    true = lambda c: F.coalesce(c, F.lit(False))
    lost = true(F.max(F.col("is_changed") & ~F.col("is_new") & ~F.col("included")).over(before))
    announced = true(F.max(F.col("is_new") & F.col("notify")).over(before))
    df = changed.withColumn("_initial", (true(F.col("had_initial")) | announced) & ~lost)
    new_notice = ~F.col("is_changed") & F.col("new_item") & F.col("notice").isNotNull()
    makes = ~F.col("is_new") & ~F.col("_initial") & F.col("notify") & ((F.col("is_changed") & (F.col("included") | true(F.col("ever_sent")))) | new_notice)
    df = df.withColumn("_update", true(F.col("had_update")) | true(F.max(makes).over(before)))
    pending = F.when(F.col("_initial"), "NEW").when(F.col("_update"), "UPDATE")
    action = merge.event_action(pending, F.col("included"), F.col("is_changed"), F.col("notify"), true(F.col("ever_sent")), F.col("new_item"), F.col("notice").isNotNull())
    action = F.when(F.col("is_new"), F.when(F.col("notify"), "INSERT_NEW").otherwise("TOUCH")).otherwise(action)
    target = F.when(F.col("is_new") | F.col("_initial"), "INITIAL").otherwise("UPDATE")
    return df.withColumns({"action": action, "target": target}).drop("_initial", "_update")


def event_contents(acted: DataFrame, earlier: DataFrame) -> DataFrame:
    """entity, target, changes and change_details of each event that a run's rows (of actions()) make, rewrite or extend.

    earlier (entity, target, changes, change_details) has what pending events said
    before. A rewritten announcement says what its last rewriting row says; extended
    events add labels in the order in which they first came, and of each field the
    first old and the last new value, without fields that came back. A notice without
    a changed field starts the details anew.
    """
    keys = ["entity", "target"]
    rows = acted.where(F.col("action").isin("INSERT_NEW", "INSERT_UPDATE", "REWRITE", "EXTEND"))
    anew = F.col("action").isin("INSERT_NEW", "REWRITE")
    starts = rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(anew, F.col("seq"))), F.lit(BEFORE)).alias("_from"), F.coalesce(F.max(F.when((F.col("action") == "EXTEND") & ~F.col("is_changed"), F.col("seq"))), F.lit(BEFORE - 1)).alias("_reset"))
    said = rows.select(*keys, "seq", "labels", "details").unionByName(earlier.select(*keys, F.lit(BEFORE).cast("long").alias("seq"), F.col("changes").alias("labels"), F.col("change_details").alias("details")))
    said = said.join(starts, keys).where(F.col("seq") >= F.col("_from"))
    labels = said.select(*keys, "seq", F.posexplode("labels").alias("pos", "label")).groupBy(*keys, "label").agg(F.min(F.struct("seq", "pos")).alias("first"))
    labels = labels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]).alias("changes"))
    each = said.where(F.col("seq") > F.col("_reset")).select(*keys, "seq", F.posexplode("details").alias("pos", "d")).withColumn("field", F.col("d.field"))
    original = F.first("d.old").over(Window.partitionBy(*keys, "field").orderBy("seq"))
    each = each.withColumn("_back", original.eqNullSafe(F.col("d.new"))).withColumn("_old", original)
    back = F.max(F.when(F.col("_back"), F.col("seq"))).over(Window.partitionBy(*keys, "field"))
    each = each.withColumn("_back", F.coalesce(back, F.lit(BEFORE - 1))).where(F.col("seq") > F.col("_back"))
    fields = each.groupBy(*keys, "field").agg(F.min(F.struct("seq", "pos")).alias("first"), F.max_by("d", "seq").alias("d"), F.first("_old").alias("_old"))
    fields = fields.select(*keys, F.struct("first", F.col("d").withField("old", F.col("_old")).alias("d")).alias("x"))
    details = fields.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("change_details"))
    out = starts.select(*keys).join(labels, keys, "left").join(details, keys, "left")
    return out.withColumns({"changes": F.coalesce("changes", F.array().cast("array<string>")), "change_details": F.coalesce("change_details", F.array().cast(merge.DETAILS))})
