"""Collection: which observations are kept, which notify, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import rules


def decide(df: DataFrame, only_enrollable_new: bool, show_review: bool, first_run: bool) -> DataFrame:
    """df with included, kept, notify and force_review; what is included for review only becomes REVISAR.

    Reads decision, tracked, enrollable (open today), may_be_open and first_notify.
    """
    rescued = F.lit(show_review) & ~F.col("decision.include") & F.col("decision.reviewable")
    include = F.col("decision.include") | rescued
    probable = ~F.col("enrollable") & F.col("may_be_open")
    hidden = F.lit(only_enrollable_new) & ~F.col("tracked") & ~(F.col("enrollable") | probable) & F.lit(not show_review)
    kept = ~hidden & (include | F.col("tracked"))
    notify = F.col("first_notify") if first_run else F.lit(True)
    if only_enrollable_new:
        notify = notify & include & (F.col("tracked") | F.col("enrollable") | probable)
    return df.withColumns({"compatibility": F.when(rescued, rules.REVIEW).otherwise(F.col("compatibility")), "included": include, "kept": F.coalesce(kept, F.lit(False)), "notify": F.coalesce(notify, F.lit(False)), "force_review": F.coalesce(probable, F.lit(False))})


def counters(df: DataFrame, *by: str) -> DataFrame:
    """fetched, included, tracked_kept, filtered, compatible, review and not_compatible, of all or by the given columns. Dropped rows count as fetched and filtered only; what is kept although it is excluded is not compatible."""
    included, compatible = F.col("kept") & F.col("included"), F.col("compatibility") == rules.COMPATIBLE
    return df.groupBy(*by).agg(
        F.count("*").alias("fetched"),
        F.count_if("kept").alias("included"),
        F.count_if(F.col("kept") & F.col("tracked")).alias("tracked_kept"),
        F.count_if(~F.col("kept")).alias("filtered"),
        F.count_if(included & compatible).alias("compatible"),
        F.count_if(included & ~compatible).alias("review"),
        F.count_if(F.col("kept") & ~F.col("included")).alias("not_compatible"),
    )
