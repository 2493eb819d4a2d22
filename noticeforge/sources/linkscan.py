"""Listings of any site as a plan: links whose label and surroundings speak of public employment in IT, with their dates.

A link's surroundings are the nearest row, item or card above it, found by joining the
places above the link with those of containers; a page's body and its navigation are
never taken. What to read further, and where a page's date comes from, are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import classify, text
from noticeforge.sources import elements

# --- Fixed values: labels, containers, suffixes, selectors --------------------------

#: Labels of links that lead nowhere new.
NAVIGATION = ("inicio", "volver", "ver más", "ver mas", "leer más", "leer mas", "avance", "abierta", "abierto", "cerrada", "cerrado", "finalizada", "finalizado", "pasar al contenido principal", "skip to main content")
#: Elements that hold one result, parts of class names that say the same, and elements that never do.
CONTAINERS, CONTAINER_CLASSES = ("article", "tr", "li"), ("views-row", "card", "resultado", "anuncio", "item", "filecontent")
NEVER = ("body", "html", "nav", "header", "footer")
NOT_LINKS = r"(?i)^(?:#|javascript:|mailto:|tel:)"
#: Files that aren't pages.
BINARY = r"(?i)\.(?:docx?|xlsx?|odt|ods|zip|rar|7z|jpe?g|png|gif|svg)$"
#: A source whose detail pages may not be read.
BLOCKED = "ayuntamiento_torredonjimeno"
#: Where a page says when it was published, the first that has a date first; then a labelled date in its text.
DATES = (("time", "", "", "datetime"), ("meta", "property", "article:published_time", "content"), ("meta", "name", "date", "content"), ("meta", "itemprop", "datePublished", "content"))
LABELLED = r"(?i)(?:fecha\s+de\s+publicaci[oó]n|fecha\s+a[ñn]adida|publicad[oa]|actualizad[oa])[^\d]{0,30}(\d{1,2}[/-]\d{1,2}[/-]\d{4})"


def contexts(rows: DataFrame) -> DataFrame:
    """key, pre, url, title and context of every link (elements with an address), and box: the place of its container (null: none)."""
    attrs = F.col("attrs")
    links = rows.where((F.col("tag") == "a") & F.col("url").isNotNull() & ~F.coalesce(F.trim(attrs["href"]).rlike(NOT_LINKS) | (F.trim(attrs["href"]) == ""), F.lit(True)))
    links = links.select("key", "pre", "url", "up")
    named = F.lower(F.coalesce(attrs["class"], F.lit("")))
    holds = F.col("tag").isin(*CONTAINERS) | F.greatest(*(F.contains(named, F.lit(c)) for c in CONTAINER_CLASSES))
    boxes = rows.where(~F.col("tag").isin("", *NEVER)).select("key", F.col("pre").alias("above"), holds.alias("holds"))
    above = links.select("key", "pre", F.posexplode("up").alias("at", "above"), F.size("up").alias("n")).join(boxes, ["key", "above"])
    # Without one that holds a result, the element right above the link is its surroundings.
    box = F.coalesce(F.max(F.when(F.col("holds"), F.col("above"))), F.max(F.when(F.col("at") == F.col("n") - 1, F.col("above"))))
    links = links.join(above.groupBy("key", "pre").agg(box.alias("box")), ["key", "pre"], "left").drop("up")
    said = elements.words_of(rows, links.select("key", "pre").unionByName(links.where("box IS NOT NULL").select("key", F.col("box").alias("pre"))))
    own = links.join(said.withColumnRenamed("words", "title"), ["key", "pre"], "left")
    around = said.select("key", F.col("pre").alias("box"), F.col("words").alias("context"))
    return own.join(around, ["key", "box"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "context")})


def scan(listings: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", source_col: str = "source") -> DataFrame:
    """Links of listings that name IT and public employment in label and surroundings: source, external_id, listing, url, title, context; each address of a source once, the first by listing and place."""
    rows = elements.elements(listings, id_col, html_col, url_col)
    asked = listings.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), F.regexp_replace(url_col, "#.*$", "").alias("listing"))
    links = contexts(rows).join(asked, "key").where("title <> '' AND url <> '' AND url <> listing").where(~F.lower("title").isin(*NAVIGATION))
    whole = text.normalize(F.concat_ws(" ", "title", "context"))
    links = links.where(classify.has_it_signal(whole) & classify.has_job_signal(whole))
    first = F.row_number().over(Window.partitionBy("source", "url").orderBy("key", "pre"))
    links = links.withColumn("_n", first).where("_n = 1")
    identity = text.stable_hash(text.canonical_json(F.col("source").alias("source"), F.col("url").alias("url")))
    return links.select("source", F.substring(identity, 1, 32).alias("external_id"), "listing", "url", "title", "context")


def may_hydrate(source: Column, url: Column, listing: Column) -> Column:
    """Whether a link's page is to be read: of the listing's host, a page, and not of a source that forbids it."""
    part = lambda x, what: F.try_parse_url(x, F.lit(what))
    same = F.lower(part(url, "HOST")) == F.lower(part(listing, "HOST"))
    page = F.lower(part(url, "PROTOCOL")).isin("http", "https") & ~F.coalesce(part(url, "PATH"), F.lit("")).rlike(BINARY)
    return F.coalesce((source != BLOCKED) & same & page, F.lit(False))


def published(rows: DataFrame) -> DataFrame:
    """key and published (null: none) of pages, from their markup, else from a labelled date in their text."""
    found = F.lit(None).cast("struct<place:int,pre:int,day:date>")
    for place, (tag, name, value, holds) in reversed(list(enumerate(DATES))):
        day = text.parse_date(F.substring(F.col("attrs")[holds], 1, 10))
        fits = (F.col("tag") == tag) & (F.col("attrs")[name] == value if name else F.lit(True)) & day.isNotNull()
        found = F.when(fits, F.struct(F.lit(place).alias("place"), "pre", day.alias("day"))).otherwise(found)
    out = rows.groupBy("key").agg(F.min(found).alias("markup"), elements.words().alias("words"))
    labelled = text.parse_date(F.nullif(F.regexp_extract("words", LABELLED, 1), F.lit("")))
    return out.select("key", F.coalesce("markup.day", labelled).alias("published"))
