"""Normalisation and scalar functions, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeforge.functions import rules


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, then the marks themselves."""
    ranges = [range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)]
    pairs = {}
    for r in ranges:
        for cp in r:
            bare = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
            if len(bare) == 1 and bare != chr(cp):
                pairs[chr(cp)] = bare
    marks = [chr(cp) for cp in range(0x300, 0x370) if unicodedata.combining(chr(cp))]
    return "".join(pairs) + "".join(marks), "".join(pairs.values())


def text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once for a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def some(x: Column) -> Column:
    """x, or null where it is empty."""
    return once(x, lambda x: F.when(x != "", x))


def fold(x: Column) -> Column:
    """Without accents, for Latin letters and their compatibility forms; null becomes empty. Texts of one byte a character have none."""
    return F.when(F.octet_length(text(x)) == F.length(text(x)), text(x)).otherwise(F.translate(text(x), *_fold_table()))


def normalize(x: Column) -> Column:
    """Folded, lower case, only a-z and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", " "))


def clean(x: Column) -> Column:
    """Single spaces for any run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"(?U)\s+", " "))


def normalize_reference(x: Column) -> Column:
    return F.regexp_replace(F.upper(fold(x)), "[^A-Z0-9]", "")


def extract_year(x: Column) -> Column:
    return F.regexp_extract(text(x), rules.YEAR, 1)


def parse_date(x: Column) -> Column:
    """Date in one of the known formats, else the first d/m/yyyy inside the text; invalid ones are null."""
    return once(clean(x), _date_of)


def _date_of(c: Column) -> Column:
    # Day and month may have one digit; the session must not throw on what doesn't parse. A failed attempt is dear, so only texts that may have a format try it.
    may = {"yyyy-M-d": c.rlike(r"^[+-]?\d{4}"), "d/M/yyyy": F.contains(c, F.lit("/")), "d-M-yyyy": F.contains(c, F.lit("-"))}
    known = [F.when(fits, F.try_to_date(c, f)) for f, fits in may.items()]
    compact = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    stamp = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$"), F.try_to_date(F.substring_index(c, "T", 1), "yyyy-M-d"))
    inside = some(F.regexp_extract(c, r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})", 1))
    return F.coalesce(*known, compact, stamp, F.try_to_date(F.regexp_replace(inside, "-", "/"), "d/M/yyyy"))


def title_signature(x: Column) -> Column:
    out = normalize(x)
    for p in (rules.GENERIC_TITLE_WORDS, rules.TITLE_YEARS, rules.TITLE_NUMBERS):
        out = F.regexp_replace(out, p, " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_json(*fields: Column) -> Column:
    """Compact JSON of named columns; give them in alphabetical order. Nulls stay."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def stable_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def string_hash(x: Column) -> Column:
    """Hash of a bare string, which is hashed with its JSON quotes."""
    quoted = F.to_json(F.array(text(x)))
    return F.sha2(F.substring(quoted, F.lit(2), F.length(quoted) - 2), 256)


def redact_secrets(x: Column) -> Column:
    for pattern, to in rules.SECRETS:
        x = F.regexp_replace(x, pattern, to)
    return x


def redacted(value: str) -> str:
    """The same for a text on the driver."""
    for pattern, to in rules.SECRETS:
        value = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), value)
    return value


def redact_url(x: Column) -> Column:
    return F.regexp_replace(x, r"/bot[^/\s]{20,}/", "/bot<redacted>/")


def contains_any(x: Column, needles) -> Column:
    """Whether one of the needles occurs, as a balanced tree of plain searches, which are compiled."""
    tests = [F.contains(x, F.lit(n)) for n in needles] or [F.lit(False)]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
    return tests[0]


def hits(x: Column, needles) -> Column:
    """The needles that occur, in their order."""
    return once(x, lambda x: F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(x, n)))


def milestone_date(title: Column) -> Column:
    """ISO date of an explicit "D de MES de YYYY"; empty if there is none or it isn't valid."""
    p = rf"(?:fecha\s+)?(\d{{1,2}})\s+de\s+({'|'.join(rules.MONTHS)})\s+de\s+(\d{{4}})"
    n = normalize(title)
    month = F.array_position(F.array(*map(F.lit, rules.MONTHS)), F.regexp_extract(n, p, 2))
    day = F.try_to_date(F.concat_ws("/", F.regexp_extract(n, p, 1), month.cast("string"), F.regexp_extract(n, p, 3)), "d/M/yyyy")
    return text(day.cast("string"))


def folder_of(url: Column, hosts=("martos.es", "www.martos.es")) -> Column:
    """Struct (id, title) of a document's official process folder, or null."""
    path = F.try_parse_url(url, F.lit("PATH"))
    raw = F.regexp_extract(path, rules.FOLDER_PATH, 2)
    # "+" isn't a space here, other than url_decode has it.
    title = F.regexp_replace(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), "-", " ")
    low = F.lower(title)
    fits = F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts) & (raw != "") & F.contains(low, F.lit("convocatoria")) & F.contains(low, F.lit("plaza")) & F.contains(low, F.lit("informatic"))
    return F.when(fits, F.struct(F.regexp_extract(path, rules.FOLDER_PATH, 1).alias("id"), F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.expr("''")), F.substring(low, F.lit(2), F.length(low))).alias("title")))


def searchable(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def escape_limited(x: Column, budget: int) -> Column:
    """HTML-escaped text of at most budget characters; no entity is cut, a cut text ends in an ellipsis."""
    chars = F.split(text(x), "")
    esc = F.transform(chars, lambda c: F.when(c == "&", "&amp;").when(c == "<", "&lt;").when(c == ">", "&gt;").when(c == '"', "&quot;").when(c == "'", "&#x27;").otherwise(c))
    whole = F.array_join(esc, "")
    start = F.struct(F.lit("").alias("s"), F.lit(True).alias("go"))
    cut = F.aggregate(esc, start, lambda a, c: F.struct(F.when(a["go"] & (F.length(a["s"]) + F.length(c) <= budget - 1), F.concat(a["s"], c)).otherwise(a["s"]).alias("s"), (a["go"] & (F.length(a["s"]) + F.length(c) <= budget - 1)).alias("go")), lambda a: F.concat(a["s"], F.lit("…")))
    return F.when(F.length(whole) <= budget, whole).otherwise(cut)


def date_es(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "dd/MM/yyyy"), F.lit(""))


def safe_url(x: Column) -> Column:
    return F.when(F.lower(F.try_parse_url(x, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(x, F.lit("HOST")).isNotNull(), x).otherwise("")


def first_label(x: Column, labels, otherwise: str) -> Column:
    """Label of the first needle that occurs: labels is a sequence of (needle, label)."""
    out = F.when(F.lit(False), "")
    for needle, label in labels:
        out = out.when(F.contains(x, F.lit(needle)), label)
    return out.otherwise(otherwise)
