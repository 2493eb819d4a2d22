"""The notification outbox: claims, transitions, reminders, eligibility at dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import rules

#: Delivery attempts of a retryable event, and minutes after which a send in progress counts as uncertain. Fixed values.
MOST_ATTEMPTS, STALE_MINUTES = 5, 30


def claimable(outbox: DataFrame) -> DataFrame:
    return outbox.where((F.col("status") == "PENDING") | ((F.col("status") == "RETRYABLE") & (F.col("attempts") < MOST_ATTEMPTS)))


def claim(outbox: DataFrame, n: int, ids: list[str] | None = None) -> DataFrame:
    """The oldest n events that may be sent, as they are once claimed. n bounds what comes to one task."""
    own = claimable(outbox) if ids is None else claimable(outbox).where(F.col("event_id").isin(ids))
    return own.orderBy("created_at", "event_id").limit(n).withColumns({"status": F.lit("SENDING"), "attempts": F.col("attempts") + 1})


def apply_claim(outbox: DataFrame, claimed: DataFrame) -> DataFrame:
    return outbox.join(claimed.select("event_id"), "event_id", "left_anti").unionByName(claimed.select(*outbox.columns))


def _where(outbox: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return outbox.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def release(outbox: DataFrame, chosen: Column) -> DataFrame:
    """Claims that weren't sent become pending again, an attempt less."""
    return _where(outbox, chosen & (F.col("status") == "SENDING"), {"status": F.lit("PENDING"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0))})


def mark(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Outcomes of deliveries (event_id, new_status, sent_at, message_id); a sent event stays sent, sent_at and message_id stay as first set."""
    own = results.select("event_id", "new_status", F.col("sent_at").alias("_at"), F.col("message_id").alias("_message"))
    both = outbox.join(own, "event_id", "left")
    hit = F.col("new_status").isNotNull() & (F.col("status") != "SENT")
    changes = {"sent_at": F.coalesce("sent_at", "_at"), "message_id": F.coalesce("message_id", "_message"), "status": F.col("new_status")}
    return _where(both, hit, changes).select(*outbox.columns)


def recover_stale(outbox: DataFrame, now: Column) -> DataFrame:
    old = F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(STALE_MINUTES))
    return _where(outbox, (F.col("status") == "SENDING") & old, {"status": F.lit("UNCERTAIN")})


def retry(outbox: DataFrame, chosen: Column) -> DataFrame:
    return _where(outbox, chosen & F.col("status").isin("RETRYABLE", "UNCERTAIN", "SUPPRESSED"), {"status": F.lit("PENDING")})


def suppress(outbox: DataFrame, chosen: Column) -> DataFrame:
    return _where(outbox, chosen & (F.col("status") != "SENT"), {"status": F.lit("SUPPRESSED")})


def reminders(processes: DataFrame, made: DataFrame, today: Column, days_before: list[int]) -> DataFrame:
    """process_id, deadline, days_before and event_key of reminders that are due and not made yet."""
    due = processes.where(F.col("deadline_confirmed") & ~F.col("status").isin(*rules.NO_REMINDER_STATUSES))
    due = due.where((F.col("compatibility") != rules.NOT_COMPATIBLE) & (F.col("access") != rules.INTERNAL_ONLY))
    due = due.withColumn("days_before", F.datediff("deadline", today)).where(F.col("days_before").isin(days_before))
    due = due.select(F.col("id").alias("process_id"), "deadline", "days_before")
    new = due.join(made.select("process_id", "deadline", "days_before"), ["process_id", "deadline", "days_before"], "left_anti")
    return new.withColumn("event_key", F.concat_ws(":", F.lit("reminder"), F.col("process_id").cast("string"), F.date_format("deadline", "yyyy-MM-dd"), F.col("days_before").cast("string")))


def dispatch_decision(kind: Column, include: Column, review: Column, followed: Column, open_today: Column, may_be_open: Column, explicit_only: bool = True) -> Column:
    """SEND, SEND_AS_REVIEW or SUPPRESS, from the snapshot as it is judged today."""
    eligible = include | review
    need_follow = kind.isin("UPDATE", "REMINDER") & F.lit(explicit_only) & ~followed
    need_open = kind.isin("NEW", "REVIEW", "REMINDER") & ~open_today & ~((kind == "REVIEW") & may_be_open)
    return F.when(~eligible | need_follow | need_open, "SUPPRESS").when((kind == "NEW") & ~include & review, "SEND_AS_REVIEW").otherwise("SEND")
