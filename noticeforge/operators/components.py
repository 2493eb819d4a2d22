"""Connected components of links between labels, by tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """label and component (the smallest label that links lead to) of every label with a link (a, b).

    In each round a label takes the smallest component among its own and its
    neighbours', and then that component's component; cut writes a round's table.
    Rounds grow with the logarithm of a component's extent in practice. Null ends and
    links to itself are left out; an empty table gives an empty result.
    """
    links = links.where("a <> b")
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")), "component")
    while True:
        near = both.join(state.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = state.join(near, "a").select("a", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        jump = step.select(F.col("a").alias("_c"), F.col("c").alias("_next"))
        done = cut(step.join(jump, step["c"] == jump["_c"], "left").select("a", "was", F.least("c", F.coalesce("_next", "c")).alias("c")), "component")
        if done.where("was <> c").isEmpty():
            return done.select(F.col("a").alias("label"), F.col("c").alias("component"))
        state = done.select("a", "c")
