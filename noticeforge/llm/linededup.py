"""Line dedup by the spread of a line over distinct sites, in DataFrame operations only.

A site is a document's source. Per line hash a HyperLogLog sketch of the sites is
built in each task and merged by the aggregation. Estimates well above the
threshold make a line boilerplate, those well below don't, those in between get
an exact distinct count. Boilerplate lines leave every text that has them, whatever
their length and whatever part of the text they are.

One kind of text stays whole: that without a line of its own, where nothing would be
left. It is a copy of a much-copied document rather than a document with boilerplate,
and near-duplicate stages judge it.

Lines are compared without white space at their ends; blank lines aren't lines.

Cases: a null text stays null, an empty one empty; a null source is a site of its
own; repeated rows change no spread, as sites are distinct; rows keep all their
columns. The order of the lines that stay is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
#: Binary logarithm of the sketches' registers; their relative error is about 1.04 / sqrt(2 ^ LG_K).
LG_K = 8
#: Estimates within this part of the threshold get exact counts: three times that error.
NEAR = 0.2
BLANKS = " \t\r"


def _lines(text):
    return F.split(text, "\n", -1)


def _hash(line):
    """Hash of a line; null for blank ones."""
    own = F.btrim(line, F.lit(BLANKS))
    return F.when(own != "", F.xxhash64(own))


def _hashes(text):
    return F.array_compact(F.array_distinct(F.transform(_lines(text), _hash)))


def boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """line (hash) and sites (estimated or, near the threshold, exact) of boilerplate lines."""
    lines = df.select(F.xxhash64(site_col).alias("site"), F.explode(_hashes(F.col(text_col))).alias("line"))
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    likely = common.cut(spread.where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - NEAR)))), "lines-spread")
    sure = min_sites * (1 + NEAR) + 1
    near = likely.where(F.col("sites") < sure).select("line")
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return likely.where(F.col("sites") >= sure).select("line", "sites").unionByName(exact)


def remove_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, details: bool = False) -> DataFrame:
    """The rows without boilerplate lines; with details also n_lines and n_removed (these replace columns of those names)."""
    found = common.cut(boilerplate(df, text_col, site_col, min_sites), "lines-boilerplate")
    text = F.col(text_col)
    # Rows are told apart by a hash of all their columns: equal rows lose equal lines.
    key = [F.xxhash64(*df.columns).alias("_key"), F.xxhash64(F.lit("again"), *df.columns).alias("_key2")]
    own = df.select(*key, F.explode(_hashes(text)).alias("line"))
    hit = own.join(found.select("line"), "line").groupBy("_key", "_key2").agg(F.collect_set("line").alias("_gone"))
    out = df.select("*", *key).join(hit, ["_key", "_key2"], "left")
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains("_gone", _hash(x)), F.lit(False)))
    whole = F.col("_gone").isNull() | ~F.exists(kept, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    if details:
        out = out.withColumn("n_lines", F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long"))
        out = out.withColumn("n_removed", F.when(whole | text.isNull(), F.lit(0)).otherwise(F.size(_lines(text)) - F.size(kept)).cast("long"))
    new = F.when(whole, text).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(c) if c == text_col else F.col(c) for c in df.columns if not (details and c in ("n_lines", "n_removed"))]
    return out.select(*columns, *(["n_lines", "n_removed"] if details else []))


def sql(min_sites: int = MIN_SITES) -> str:
    """The same for DuckDB, with exact counts throughout."""
    return f"""
    WITH l AS (
        SELECT rowid_ AS r, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)
    ), n AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
    b AS (
        SELECT line FROM n WHERE line <> ''
        GROUP BY line HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {min_sites}
    ), d AS (
        SELECT r, count(*) AS n_lines, count(b.line) AS hits, bool_or(b.line IS NULL AND n.line <> '') AS has_own,
            string_agg(raw, chr(10) ORDER BY i) FILTER (b.line IS NULL) AS rest
        FROM n LEFT JOIN b ON n.line = b.line GROUP BY r
    )
    SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
        CAST(CASE WHEN has_own THEN hits ELSE 0 END AS BIGINT) AS n_removed,
        md5(CASE WHEN has_own AND hits > 0 THEN coalesce(rest, '') ELSE text END) AS text_md5
    FROM (SELECT row_number() OVER () AS rowid_, * FROM documents) t LEFT JOIN d ON t.rowid_ = d.r
    """
