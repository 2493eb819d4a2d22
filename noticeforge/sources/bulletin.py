"""Whole bulletins as tables of lines: the contents, and the edicts whose bodies follow in the same order.

Lines are rows. What a line is follows from the line alone; which organisation,
department and title it belongs to are windows over the lines before it: headings
carry on until the next one, a title is what stands between a heading (or the
reference before) and its own reference. Bodies begin at lines with a number; entries
take them in the order of the contents, each after the one before, so that a number
quoted in a body doesn't begin another edict. What is wrong with a bulletin is a row
as well, and other bulletins go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import classify, text
from noticeforge.operators import scratch

# --- Fixed values: headings, wordings and patterns (on folded lines where it says so) ---

#: Folded lines that begin a section.
SECTIONS = ("administracion local", "administracion autonomica", "administracion de justicia", "administracion del estado", "junta de andalucia", "anuncios no oficiales")
#: How the folded line of an organisation in capitals begins.
ORGANISATIONS = (
    "ayuntamiento de ", "diputacion provincial de ", "entidad local autonoma ", "mancomunidad ", "consorcio ", "comunidad de regantes", "consejeria de ", "delegacion territorial de ",
    "agencia ", "instituto ", "patronato ", "ministerio ", "subdelegacion del gobierno", "confederacion hidrografica", "juzgado ", "camara oficial ",
)
#: Any other organisation's line, and the words of which its folded form has one.
CAPITALS = r"^[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑ\s.,'’()/-]{4,180}$"
ORGANISATION_WORDS = ("ayuntamiento", "diputacion", "consejeria", "consorcio", "mancomunidad", "comunidad", "juzgado")
#: A department's folded line, and its greatest length.
DEPARTMENT = r"^(?:area de |secretaria general$|servicio de |intervencion$|recursos humanos$|delegacion territorial en |presidencia$)"
DEPARTMENT_CHARS = 140
#: Folded lines that say nothing: numbers, pages, dates; the publisher's with its page.
EMPTY_LINES = (r"^numero\s+\d+$", r"^pag\.?\s*\d+$", r"^(?:lunes|martes|miercoles|jueves|viernes|sabado|domingo),?.*\d{4}$")
PUBLISHER, PAGE = "instituto de estudios giennenses", "pagina"
#: A reference in the contents, and the beginning of a body.
REFERENCE = r"(?i)^\s*BOP[-\s](\d{4})[-/](\d{1,8})\s*$"
BODY = r"^\s*(\d{4})/(\d{1,8})(?:\s|$)"
#: Who publishes what has no organisation.
NOBODY = "BOP de Jaen"
#: Characters of an edict in which public employment must be named.
OPENING = 4000

#: Where a line ends.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def line_kind(line: Column, folded: Column) -> Column:
    """What a line of the contents is, by itself: empty, section, reference, organisation, department or title."""
    nothing = (folded == "") | F.greatest(*(folded.rlike(p) for p in EMPTY_LINES)) | (F.startswith(folded, F.lit(PUBLISHER)) & F.contains(folded, F.lit(PAGE)))
    capitals = (line == F.upper(line)) & F.greatest(*(F.startswith(folded, F.lit(p)) for p in ORGANISATIONS))
    named = line.rlike(CAPITALS) & F.greatest(*(F.contains(folded, F.lit(w)) for w in ORGANISATION_WORDS))
    department = (F.length(line) <= DEPARTMENT_CHARS) & folded.rlike(DEPARTMENT)
    return F.when(nothing, "empty").when(folded.isin(*SECTIONS), "section").when(line.rlike(REFERENCE), "reference").when(capitals | named, "organisation").when(department, "department").otherwise("title")


def lines(bulletins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, pos, line (spaces made single), kind, number (of a body that begins here, else null) and first (where the first body begins)."""
    whole = bulletins.select(F.col(id_col).alias("key"), F.split(F.coalesce(text_col, F.lit("")), LINE_ENDS, -1).alias("raws"))
    # A bulletin's lines tell where the first body begins before they are rows, so nothing needs to gather them for that.
    at = F.array_position(F.transform("raws", lambda x: x.rlike(BODY)), True).cast("int")
    rows = whole.select("key", F.when(at > 0, at - 1).alias("first"), "raws").select("key", "first", F.posexplode("raws").alias("pos", "raw"))
    begins = F.when(F.col("raw").rlike(BODY), F.concat_ws("/", F.regexp_extract("raw", BODY, 1), F.regexp_extract("raw", BODY, 2)))
    rows = rows.select("key", "pos", text.clean(F.col("raw")).alias("line"), begins.alias("number"), "first")
    rows = rows.withColumn("folded", text.normalize(F.col("line")))
    return rows.select("key", "pos", "line", line_kind(F.col("line"), F.col("folded")).alias("kind"), "number", "first")


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")


def contents(rows: DataFrame) -> DataFrame:
    """key, part, pos, reference, number, title (null: none), organisation and repeated of the entries before a bulletin's first body."""
    own = rows.where("pos < first AND kind <> 'empty'")
    by_pos = Window.partitionBy("key").orderBy("pos")
    heading, ends = F.col("kind").isin("section", "organisation"), F.col("kind").isin("section", "organisation", "reference")
    own = own.withColumns({"part": F.sum(ends.cast("int")).over(by_pos), "head": F.sum(heading.cast("int")).over(by_pos)})
    # A line that looks like a department's is one until the title has begun.
    begun = F.max((F.col("kind") == "title").cast("int")).over(Window.partitionBy("key", "part").orderBy("pos"))
    own = own.withColumn("begun", begun == 1)
    is_title = F.col("kind").isin("title", "department") & F.col("begun")
    organisation = F.last(F.when(F.col("kind") == "organisation", F.col("line")), ignorenulls=True).over(by_pos)
    department = F.last(F.when((F.col("kind") == "department") & ~F.col("begun"), F.col("line")), ignorenulls=True).over(Window.partitionBy("key", "head").orderBy("pos"))
    own = own.withColumn("organisation", F.concat_ws(" - ", organisation, department))
    titles = own.where(is_title).groupBy("key", (F.col("part") + 1).alias("part")).agg(_joined().alias("title"))
    entries = own.where("kind = 'reference'").join(titles, ["key", "part"], "left")
    year, number = (F.regexp_extract("line", REFERENCE, k) for k in (1, 2))
    entries = entries.select("key", "pos", F.concat_ws("-", F.lit("BOP"), year, number).alias("reference"), F.concat_ws("/", year, number).alias("number"), "title", F.coalesce(F.nullif("organisation", F.lit("")), F.lit(NOBODY)).alias("organisation"))
    repeated = F.row_number().over(Window.partitionBy("key", "reference").orderBy("pos")) > 1
    return entries.withColumns({"part": F.row_number().over(by_pos), "repeated": repeated})


def starts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """key, part and start (null: none) of each entry: the first place of its number after the entry before."""
    places = rows.where("number IS NOT NULL").groupBy("key", "number").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    asked = entries.join(places, ["key", "number"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("places", F.array().cast("array<int>")).alias("places")))).alias("asked"))

    def step(state, entry):
        after = F.array_min(F.filter(entry["places"], lambda p: p > state["at"]))
        # Once an entry has none, no later one is looked for.
        return F.struct(F.coalesce(after, F.lit(2**31 - 1)).alias("at"), F.concat(state["found"], F.array(F.struct(entry["part"].alias("part"), after.alias("start")))).alias("found"))

    none = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<part:int,start:int>>").alias("found"))
    return asked.select("key", F.inline(F.aggregate("asked", none, step)["found"]))


def bodies(rows: DataFrame, begun: DataFrame) -> DataFrame:
    """key, part and body: the lines from an entry's start up to the next one's, without those that say nothing."""
    marked = rows.where("pos >= first").join(begun.where("start IS NOT NULL").select("key", F.col("start").alias("pos"), "part"), ["key", "pos"], "left")
    carried = F.last("part", ignorenulls=True).over(Window.partitionBy("key").orderBy("pos"))
    return marked.withColumn("part", carried).where("part IS NOT NULL AND kind <> 'empty'").groupBy("key", "part").agg(_joined().alias("body"))


def read(bulletins: DataFrame, id_col: str, text_col: str, cut: Callable[[DataFrame, str], DataFrame] = scratch.cut) -> DataFrame:
    """A row for each edict (part, reference, title, organisation, body), or one with the error of a bulletin that can't be split.

    Cases: null and empty texts have no edict, an error; ids must be unique and not
    null; an empty table gives an empty result. Several steps read the lines, the entries
    and the edicts, so each of these is made once, and cut writes it.
    """
    rows = cut(lines(bulletins, id_col, text_col), "lines")
    entries = cut(contents(rows), "entries")
    whole = cut(entries.join(starts(rows, entries), ["key", "part"]), "begun")
    whole = whole.join(bodies(rows, whole.select("key", "part", "start")), ["key", "part"], "left")
    whole = cut(whole.withColumn("body", F.coalesce("body", F.lit(""))), "edicts")
    # Of the things that are wrong with a bulletin, the first by stage and place.
    said = lambda stage, message: F.struct(F.lit(stage).alias("stage"), F.col("pos"), message.alias("message"))
    bad = F.when(F.col("repeated"), said(1, F.concat("reference", F.lit(" is repeated"))))
    bad = bad.when(F.col("title").isNull(), said(1, F.concat("reference", F.lit(" has no title"))))
    bad = bad.when(F.col("start").isNull(), said(2, F.concat("reference", F.lit(" has no body"))))
    bad = bad.when(F.length("body") < F.length("title"), said(3, F.concat("reference", F.lit(" is too short"))))
    sums = rows.groupBy("key").agg(F.max("first").alias("first")).join(whole.groupBy("key").agg(F.min(bad).alias("bad")), "key", "left")
    found = sums.join(entries.select("key").distinct().withColumn("some", F.lit(True)), "key", "left")
    error = F.when(F.col("first").isNull(), "no edict begins").when(F.col("some").isNull(), "no references in the contents").otherwise(F.col("bad.message"))
    errors = found.select("key", error.alias("error"))
    good = whole.join(errors.where("error IS NULL"), "key").select("key", "part", "reference", "title", "organisation", "body", "error")
    names = good.columns[1:-1]
    failed = errors.where("error IS NOT NULL").select("key", *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in names), "error")
    return good.unionByName(failed).withColumnRenamed("key", id_col)


def is_it_job(title: Column, organisation: Column, body: Column) -> Column:
    """Whether the heading names IT, and the heading or the opening of the body public employment."""
    heading = F.concat_ws(" ", title, organisation)
    opening = F.concat_ws(" ", heading, F.substring(body, 1, OPENING))
    return classify.has_it_signal(text.normalize(heading)) & classify.has_job_signal(text.normalize(opening))
