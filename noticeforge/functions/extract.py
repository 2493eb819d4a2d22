"""Typed fields from free text, as column expressions. All yield null or empty where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeforge.functions import rules, text

ANY_CASE = "(?iu)"


def context(x: Column, pattern: str, before: int, after: int) -> Column:
    """Cleaned window around the first match, without regard to case."""
    return text.once(x, lambda x: text.clean(_window(x, ANY_CASE + f"(?:{pattern})", before, after)))


def _window(x: Column, pattern: str, before: int, after: int) -> Column:
    """The first match with so many characters before and after it; null if there is none."""

    def around(at: Column) -> Column:
        start = F.greatest(at - 1 - before, F.lit(0))
        return F.when(at > 0, F.substring(x, start + 1, at - 1 + F.length(F.regexp_extract(x, pattern, 0)) + after - start))

    return text.once(F.regexp_instr(x, F.lit(pattern)), around)


def qualification(x: Column) -> Column:
    return context(x, rules.QUALIFICATION_CUES, 50, 650)


def group(x: Column) -> Column:
    corps = lambda c: F.when(F.startswith(c, F.lit("b")), "B").otherwise(F.upper(c))
    return text.once(text.normalize(x), lambda n: F.coalesce(F.upper(text.some(F.regexp_extract(n, rules.GROUP, 1))), text.once(F.regexp_extract(n, rules.CORPS, 1), corps)))


def positions(x: Column) -> Column:
    words = F.create_map(*(F.lit(v) for kv in rules.NUMBER_WORDS.items() for v in kv))

    def found(n: Column) -> Column:
        a, b, c = (text.some(F.regexp_extract(n, p, 1)) for p in rules.POSITIONS)
        return F.coalesce(a.cast("int"), b.cast("int"), F.try_element_at(words, c))

    return text.once(text.normalize(x), found)


def _first_clean(x: Column, pattern: str) -> Column:
    """First date whose lead-in has no mark of a legal act. Matches that are refused use up their text."""
    whole = F.regexp_extract_all(x, F.lit(ANY_CASE + f"({pattern})"), F.lit(1))
    date = r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})$"
    fine = F.filter(whole, lambda m: ~F.regexp_replace(m, date, "").rlike(ANY_CASE + rules.ACT_DATES))
    return text.some(F.regexp_extract(F.get(fine, 0), date, 1))


def deadline(x: Column) -> Column:
    """Struct (date, confirmed)."""

    def found(c: Column) -> Column:
        return F.coalesce(text.some(F.regexp_extract(c, ANY_CASE + rules.DEADLINE_RANGE, 2)), *(_first_clean(c, p) for p in rules.DEADLINES))

    return text.once(text.once(text.clean(x), found), lambda d: F.struct(text.parse_date(d).alias("date"), d.isNotNull().alias("confirmed")))


def relative_deadline(x: Column) -> Column:
    """Struct (days, kind, starts_after, text) of a period that runs from a publication, or null."""
    # The pattern finds the same parts in its own match, which is short.
    match = text.some(F.regexp_extract(text.clean(x), ANY_CASE + rules.RELATIVE_DEADLINE, 0))
    parts = lambda m: F.when(m.isNotNull(), F.array(m, *(F.regexp_extract(m, ANY_CASE + rules.RELATIVE_DEADLINE, k) for k in (1, 2, 3))))
    return text.once(text.once(match, parts), _period)


def _period(parts: Column) -> Column:
    match, number, kind, tail = (F.get(parts, k) for k in range(4))
    words = F.create_map(*(F.lit(v) for kv in rules.DAY_WORDS.items() for v in kv))
    days = F.coalesce(F.expr("null").cast("int"), F.try_element_at(words, F.lower(number)), F.nullif(F.regexp_extract(number, r"^(\d+)$", 1), F.lit("")).cast("int"))
    after = (
        F.when(tail.rlike(r"\bBOE\b|Bolet[ií]n Oficial del Estado"), "BOE")
        .when(tail.rlike(r"\bBOJA\b|Junta de Andaluc"), "BOJA")
        .when(tail.rlike(r"\bBOP\b|Provincia"), "BOP")
        .otherwise("")
    )
    found = F.struct(
        days.alias("days"),
        F.when(F.startswith(F.lower(kind), F.lit("h")), "habiles").otherwise("naturales").alias("kind"),
        after.alias("starts_after"),
        F.substring(text.clean(match), 1, 300).alias("text"),
    )
    return F.when((number != "") & tail.rlike(ANY_CASE + "publicaci[oó]n|siguiente") & (days > 0), found)


def exam_date(x: Column) -> Column:
    return text.parse_date(F.coalesce(*(_first_clean(text.text(x), p) for p in rules.EXAM_DATES)))


def _near_exam(x: Column, before: int, after: int) -> Column:
    return text.once(text.text(x), lambda x: _window(x, ANY_CASE + f"(?:{rules.EXAM})", before, after))


def exam_is_provisional(x: Column) -> Column:
    return F.coalesce(text.normalize(_near_exam(x, 160, 260)).rlike(rules.PROVISIONAL_CUES), F.lit(False))


def exam_time(x: Column) -> Column:
    first, second = rules.EXAM_TIMES
    first = ANY_CASE + first

    def said(near: Column) -> Column:
        told = lambda p: F.concat(F.lpad(F.regexp_extract(near, p, 1), 2, "0"), F.lit(":"), F.regexp_extract(near, p, 2))
        return F.when(near.rlike(first), told(first)).when(near.rlike(second), told(second))

    return text.once(_near_exam(x, 100, 500), said)


def exam_place(x: Column) -> Column:

    def said(near: Column) -> Column:
        named, room = (text.clean(F.regexp_extract(near, ANY_CASE + p, 1)) for p in rules.EXAM_PLACES)
        return F.when(near.rlike(ANY_CASE + rules.EXAM_PLACES[0]), named).otherwise(room)

    return text.once(text.clean(_near_exam(x, 100, 500)), said)


def references(x: Column) -> Column:
    """Normalised official references, distinct, all of the first pattern before those of the second."""
    found = [F.regexp_extract_all(text.text(x), F.lit("(?i)(" + p + ")"), F.lit(1)) for p in rules.REFERENCES]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), text.normalize_reference), lambda r: r != ""))


def signal_excerpt(x: Column, before: int = 120, after: int = 260) -> Column:
    return text.once(text.normalize(x), lambda n: F.coalesce(F.trim(_window(n, rules.IT_SIGNAL, before, after)), F.lit("")))


def label_field(x: Column, label: str, labels) -> Column:
    """Text between a label and the next known label."""
    others = "|".join(others for others in labels if others != label)
    return text.clean(F.regexp_extract(text.text(x), f"(?isu){label}\\s*:?\\s*(.*?)(?={others}|$)" if others else f"(?isu){label}\\s*:?\\s*(.*)$", 1))
