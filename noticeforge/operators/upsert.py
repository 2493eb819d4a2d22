"""Set-based writes: upserts, monotone checkpoints, insert-or-ignore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of both by key, the new row's columns first, except those in keep, which stay as first written. new has one row a key."""
    o = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_was"))
    n = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in old.columns if c not in keys), F.lit(True).alias("_is"))
    both = o.join(n, keys, "full_outer")

    def pick(c):
        first, then = ("_old_", "_new_") if c in keep else ("_new_", "_old_")
        flag = "_was" if c in keep else "_is"
        return F.when(F.col(flag), F.col(first + c)).otherwise(F.col(then + c)).alias(c)

    return both.select(*(F.col(c) if c in keys else pick(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old and those rows of new whose key isn't there, the first of each key by order."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("x")).select("x.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def checkpoint_max(old: DataFrame, runs: DataFrame) -> DataFrame:
    """source and covered_through: the greatest of both; only finished runs (OK, PARTIAL) with coverage move it."""
    new = runs.where(F.col("status").isin("OK", "PARTIAL") & F.col("covered_through").isNotNull()).select("source", "covered_through")
    return old.select("source", "covered_through").unionByName(new).groupBy("source").agg(F.max("covered_through").alias("covered_through"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_x")).select("_x.*")


def integrity(table: DataFrame, keys: list[str], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """check and n: repeated keys, and for each foreign key the rows without a parent."""
    out = table.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_keys").alias("check"), "n")
    for column, (parent, key) in parents.items():
        lost = table.join(parent.select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit(f"orphans_{column}").alias("check"), "n"))
    return out
