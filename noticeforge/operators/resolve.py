"""Identity resolution as staged joins: unresolved rows flow on to the next stage.

Stages: same source item, same primary reference, cited reference with a matching
title, same canonical key without a conflict, similar title within an organisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import identity

#: Newest entities of an organisation that a title is compared with, and the least similarity. Fixed values.
NEWEST, LEAST_SCORE = 100, 0.92


def follow_alias(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """df with the column led one step to its canonical entity."""
    known = aliases.select(F.col("alias_id").alias("_alias"), F.col("process_id").alias("_canonical"))
    return df.join(known, df[column] == F.col("_alias"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def by_item(observed: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """seq and process_id of observations whose source item is known; aliases are followed here only."""
    found = observed.select("seq", "source", "external_id").join(items.select("source", "external_id", "process_id"), ["source", "external_id"])
    return follow_alias(found.select("seq", "process_id"), aliases, "process_id")


def by_reference(observed: DataFrame, references: DataFrame) -> DataFrame:
    """The entity that had one of the primary references first."""
    asked = observed.select("seq", F.explode("references").alias("reference"))
    found = asked.join(references.select("reference", "process_id", "first_seen"), "reference")
    return found.groupBy("seq").agg(F.min_by("process_id", F.struct("first_seen", "process_id")).alias("process_id"))


def by_prefix(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """asked (prefix) with id, where one id alone starts with it. Eight characters are the least a prefix has, so they make an equality of the match."""
    fine = asked.where(F.col("prefix").rlike("^[0-9a-f-]{8,36}$"))
    found = fine.join(ids.select("id"), F.substring("id", 1, 8) == F.substring("prefix", 1, 8)).where(F.startswith("id", "prefix"))
    return found.groupBy(*asked.columns).agg(F.min("id").alias("id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def by_citation(observed: DataFrame, references: DataFrame, processes: DataFrame) -> DataFrame:
    """The entity of the first citation, in order, whose title is similar enough."""
    asked = observed.select("seq", "year", "group", "access", "positions", "organisation", "signature", F.posexplode("cited").alias("pos", "reference"))
    found = asked.join(references.select("reference", "process_id"), "reference").join(_sides(processes), "process_id")
    passed = found.where(identity.may_match(_new(), _old(), positions=False))
    good = passed.where(identity.token_set_ratio("signature", "old_signature") / 100 >= LEAST_SCORE)
    return good.groupBy("seq").agg(F.min_by("process_id", F.struct("pos", "process_id")).alias("process_id"))


def by_key(observed: DataFrame, processes: DataFrame, items: DataFrame) -> DataFrame:
    """The first entity with the same canonical key that isn't in conflict: same source under another id, or other posts."""
    found = observed.select("seq", "source", "external_id", "positions", "canonical_key").join(
        processes.select("canonical_key", F.col("id").alias("process_id"), F.col("positions").alias("old_positions"), "first_seen"), "canonical_key"
    )
    found = found.where(F.col("positions").isNull() | F.col("old_positions").isNull() | (F.col("positions") == F.col("old_positions")))
    return without_conflict(found, items).groupBy("seq").agg(F.min_by("process_id", F.struct("first_seen", "process_id")).alias("process_id"))


def without_conflict(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose entity has no other id of the row's source: of each entity and source the least and the greatest id tell."""
    spans = items.groupBy(F.col("process_id").alias("_p"), F.col("source").alias("_s")).agg(F.min("external_id").alias("_low"), F.max("external_id").alias("_high"))
    both = found.join(spans, (F.col("process_id") == F.col("_p")) & (F.col("source") == F.col("_s")), "left")
    other = (F.col("_low") != F.col("external_id")) | (F.col("_high") != F.col("external_id"))
    return both.where(~F.coalesce(other, F.lit(False))).select(found.columns)


def by_title(observed: DataFrame, processes: DataFrame, items: DataFrame, newest: int = NEWEST, least: float = LEAST_SCORE) -> DataFrame:
    """The entity with the most similar title among the newest of the organisation; ties go to the newest.

    Guards run before the score, which is the only part in Python.
    """
    rank = F.row_number().over(Window.partitionBy("organisation").orderBy(F.desc("last_seen"), "id"))
    recent = processes.withColumn("_rank", rank).where(F.col("_rank") <= newest)
    asked = observed.select("seq", "source", "external_id", "year", "group", "access", "positions", "organisation", "signature")
    pairs = asked.join(_sides(recent, "_rank"), asked["organisation"] == F.col("old_organisation")).where(identity.may_match(_new(), _old(), positions=True))
    scored = without_conflict(pairs, items).withColumn("score", identity.token_set_ratio("signature", "old_signature") / 100)
    return scored.where(F.col("score") >= least).groupBy("seq").agg(F.min_by(F.struct("process_id", "score"), F.struct(-F.col("score"), "_rank")).alias("x")).select("seq", "x.*")


def _sides(processes: DataFrame, *more: str) -> DataFrame:
    return processes.select(F.col("id").alias("process_id"), *(F.col(c).alias(f"old_{c}") for c in ("year", "group", "access", "positions", "organisation", "signature")), *more)


def _new() -> dict[str, Column]:
    return {c: F.col(c) for c in ("year", "group", "access", "positions", "organisation")}


def _old() -> dict[str, Column]:
    return {c: F.col(f"old_{c}") for c in ("year", "group", "access", "positions", "organisation")}


def resolve(observed: DataFrame, processes: DataFrame, items: DataFrame, references: DataFrame, aliases: DataFrame) -> DataFrame:
    """observed with process_id (null for new entities) and stage, by the first stage that finds one."""
    stages = [
        ("item", lambda o: by_item(o, items, aliases)),
        ("reference", lambda o: by_reference(o, references)),
        ("citation", lambda o: by_citation(o, references, processes)),
        ("key", lambda o: by_key(o, processes, items)),
        ("title", lambda o: by_title(o, processes, items).select("seq", "process_id")),
    ]
    left, found = observed, None
    for name, stage in stages:
        own = stage(left).select("seq", "process_id", F.lit(name).alias("stage"))
        found = own if found is None else found.unionByName(own)
        left = left.join(own.select("seq"), "seq", "left_anti")
    return observed.join(found, "seq", "left")
