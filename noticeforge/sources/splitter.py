"""Splitting one document into its parts: lines, headings, bodies up to the next anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.operators import views


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos (from 1), line (trimmed of spaces) and last (the document's last pos)."""
    own = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"), F.size(F.split(text_col, "\n", -1)).alias("last"))
    return own.select(id_col, (F.col("pos") + 1).alias("pos"), F.trim("line").alias("line"), "last")


def edicts(df: DataFrame, id_col: str, text_col: str, anchor: str = r"^\d{4}/\d+$", organisation: str = r"^(AYUNTAMIENTO|DIPUTACI[OÓ]N|UNIVERSIDAD|MINISTERIO|JUNTA)\b") -> DataFrame:
    """A row for each edict of a bulletin: its anchor, the organisation carried from above, and the body up to the next anchor."""
    own = lines(df, id_col, text_col)
    carried = views.carry(own, [id_col], [F.col("pos")], F.when(F.col("line").rlike(organisation), F.col("line")), "organisation")
    part = F.sum(F.col("line").rlike(anchor).cast("int")).over(Window.partitionBy(id_col).orderBy("pos"))
    parts = carried.withColumn("part", part).where("part > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = parts.groupBy(id_col, "part").agg(F.min_by("line", "pos").alias("reference"), F.min_by("organisation", "pos").alias("organisation"), F.min("pos").alias("pos"), body.alias("whole"))
    return out.select(id_col, "part", "reference", "organisation", "pos", F.trim(F.substring_index("whole", "\n", 1 - 10**6)).alias("_"), F.expr("substring(whole, length(reference) + 2)").alias("body")).drop("_")
