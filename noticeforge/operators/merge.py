"""Merging observations into entities: precedence, status, and the ordered fold within a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import rules


#: One change of an entity, as events say it.
DETAILS = "array<struct<field:string,label:string,old:string,new:string,source_url:string,source_reference:string,observed_at:string>>"


def status_rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in rules.STATUS_RANK.items() for v in kv)), status), F.lit(0))


def prefer_status(old: Column, new: Column) -> Column:
    """An exceptional status wins and sticks until the process reopens; else the higher rank, the new one on ties."""
    return (
        F.when(new.isin(*rules.EXCEPTIONAL_STATUSES), new)
        .when(old.isin(*rules.EXCEPTIONAL_STATUSES), F.when(new.isin(*rules.LEAVING_STATUSES), new).otherwise(old))
        .when(status_rank(new) >= status_rank(old), new)
        .otherwise(old)
    )


OLD_WINS = ("title", "organisation")
NEW_TEXT_WINS = ("locality", "province", "scope", "group", "qualification", "summary", "exam_place")
NEW_VALUE_WINS = ("positions", "publication_date", "exam_date", "exam_time")
STRUCTURED = ("positions", "publication_date", "deadline", "deadline_confirmed", "organisation")


def merged(old: str = "old", new: str = "new") -> dict[str, Column]:
    """Columns of a merged entity, from structs old and new (new may carry structured, whose fields win even if null)."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    blank = lambda c: F.nullif(c, F.lit(""))
    out = {c: F.coalesce(blank(o(c)), n(c), o(c)) for c in OLD_WINS}
    out |= {c: F.coalesce(blank(n(c)), o(c), n(c)) for c in NEW_TEXT_WINS}
    out |= {c: F.coalesce(n(c), o(c)) for c in NEW_VALUE_WINS}
    has = n("deadline").isNotNull()
    out["deadline"] = F.when(has, n("deadline")).otherwise(o("deadline"))
    out["deadline_confirmed"] = F.when(has, n("deadline_confirmed")).otherwise(o("deadline_confirmed"))
    out["access"] = F.when(n("access") == rules.UNKNOWN_ACCESS, o("access")).otherwise(n("access"))
    out["compatibility"] = F.when((n("compatibility") == rules.REVIEW) & (o("compatibility") != rules.REVIEW), o("compatibility")).otherwise(n("compatibility"))
    out["status"] = prefer_status(o("status"), n("status"))
    out["priority"] = F.greatest(o("priority"), n("priority"))
    structured = F.coalesce(n("structured"), F.lit(False))
    for c in STRUCTURED:
        out[c] = F.when(structured, n(c)).otherwise(out[c])
    return out


def status_fold(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Final status of each key after its observations in order, and their number.

    The fold is stateful, so it can't be split: a key's statuses are gathered in one array, sorted and folded.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(status).alias("_status"))))
    folded = F.aggregate(rows, F.lit(rules.STATUS_OTHERWISE), lambda state, x: prefer_status(state, x["_status"]))
    return events.groupBy(key).agg(folded.alias("final_status"), F.count("*").alias("n"))


def event_action(pending: Column, include: Column, changed: Column, notify: Column, ever_sent: Column, new_item: Column, notice: Column) -> Column:
    """What happens to an entity's events: pending is the kind of its oldest pending event (or null)."""
    initial = pending.isin("NEW", "REVIEW")
    return (
        F.when(changed & initial & include, "REWRITE")
        .when(changed & initial, "SUPPRESS")
        .when(changed & (pending == "UPDATE"), "EXTEND")
        .when(changed & notify & (include | ever_sent), "INSERT_UPDATE")
        .when(~changed & new_item & notice & notify & pending.isNotNull(), "EXTEND")
        .when(~changed & new_item & notice & notify, "INSERT_UPDATE")
        .otherwise("TOUCH")
    )


def event_key(kind: Column, process_id: Column, detail: Column) -> Column:
    """NEW and REVIEW share one key an entity; other kinds have one for each detail. Updates give the run and seq as detail, so a state that comes back is a new event."""
    return F.when(kind.isin("NEW", "REVIEW"), F.concat(F.lit("new:"), process_id)).otherwise(F.concat_ws(":", F.lower(kind), process_id, detail))


def event_id(key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit('"'), key, F.lit('"')), 256), 1, 32)
