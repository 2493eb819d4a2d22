"""Identity keys, snapshots, changes and similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from noticeforge.functions import rules, text


def canonical_key(organisation: Column, title: Column, published: Column, access: Column, group: Column) -> Column:
    """Hash over what identifies an announcement whatever its state."""
    year = F.coalesce(F.nullif(text.extract_year(published.cast("string")), F.lit("")), text.extract_year(title))
    fields = {"access": access, "group": text.normalize(group), "organisation": text.normalize(organisation), "position": text.title_signature(title), "year": year}
    return text.stable_hash(text.canonical_json(*(c.alias(k) for k, c in fields.items())))


#: Fields of a snapshot, in alphabetical order.
SNAPSHOT = ("access", "compatibility", "deadline", "deadline_confirmed", "exam_date", "exam_place", "exam_time", "group", "locality", "positions", "priority", "province", "qualification", "status")
NORMALISED = ("qualification", "exam_place", "group", "locality", "province")


def snapshot(columns: dict[str, Column], provisional: Column) -> Column:
    """JSON of the semantic fields. exam_date_provisional is there only if it isn't null: absent, null and false differ for hashing."""
    own = {k: text.normalize(columns[k]) if k in NORMALISED else columns[k] for k in SNAPSHOT}
    own["deadline_confirmed"] = F.coalesce(columns["deadline_confirmed"], F.lit(False))
    plain = text.canonical_json(*(own[k].alias(k) for k in SNAPSHOT))
    more = own | {"exam_date_provisional": provisional}
    extended = text.canonical_json(*(more[k].alias(k) for k in sorted(more)))
    return F.when(provisional.isNull(), plain).otherwise(extended)


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Labels of the new record's fields whose values differ, null-safe, in the labels' order."""
    return F.array_compact(F.array(*(F.when(~old[k].eqNullSafe(new[k]), F.lit(label)) for k, label in rules.CHANGE_LABELS.items() if k in new)))


def change_details(old: dict[str, Column], new: dict[str, Column], url: Column, reference: Column, at: Column) -> Column:
    """Array of (field, label, old, new, source_url, source_reference, observed_at) for the fields that count."""
    def one(k):
        return F.when(~old[k].eqNullSafe(new[k]), F.struct(F.lit(k).alias("field"), F.lit(rules.CHANGE_LABELS[k]).alias("label"), old[k].cast("string").alias("old"), new[k].cast("string").alias("new"), url.alias("source_url"), reference.alias("source_reference"), at.alias("observed_at")))

    return F.array_compact(F.array(*(one(k) for k in rules.DETAIL_FIELDS if k in new)))


def merge_details(previous: Column, current: Column) -> Column:
    """Per field the first old and the latest new value, without fields that came back; earlier fields first."""
    def same(d, e):
        return d["field"] == e["field"]

    def renewed(d):
        later = F.filter(current, lambda e: same(d, e))
        last = F.try_element_at(later, F.lit(-1))
        return F.when(F.size(later) > 0, last.withField("old", d["old"])).otherwise(d)

    fresh = F.filter(current, lambda e: ~F.exists(previous, lambda d: same(d, e)))
    return F.filter(F.concat(F.transform(previous, renewed), fresh), lambda d: ~d["old"].eqNullSafe(d["new"]))


def _indel(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100, by the length of the longest common subsequence (bit-parallel)."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return 200.0 * (len(a) - rows.bit_count()) / total


def token_set_similarity(a: str, b: str) -> float:
    """Similarity of two texts' token sets, 0 to 100: a subset of tokens counts as equal, empty texts as unlike."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [_indel(with_left, with_right)]
    if both:
        scores += [_indel(both, with_left), _indel(both, with_right)]
    return max(scores)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def may_match(new: dict[str, Column], old: dict[str, Column], positions: bool) -> Column:
    """Guards of the fuzzy match: years, groups, access and (if asked) numbers of posts that are known on both sides must be equal."""
    years = (new["year"] == "") | (old["year"] == "") | (new["year"] == old["year"])
    groups = (new["group"] == "") | (old["group"] == "") | (text.normalize(new["group"]) == text.normalize(old["group"]))
    access = (new["access"] == rules.UNKNOWN_ACCESS) | (old["access"] == rules.UNKNOWN_ACCESS) | (new["access"] == old["access"])
    fits = years & groups & access & (new["organisation"] == old["organisation"])
    return fits & (new["positions"].isNull() | old["positions"].isNull() | (new["positions"] == old["positions"])) if positions else fits
