"""Classification by vocabularies and ordered rules, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import rules, text


@dataclass(frozen=True)
class Profile:
    """Places and gates of whoever follows the announcements."""

    priority_places: tuple[str, ...] = ("martos",)
    nearby_places: tuple[str, ...] = ("torredelcampo", "torredonjimeno")
    city: str = "martos"
    province: str = "jaen"
    special_state: bool = True
    special_region: bool = True
    require_it_qualification: bool = False
    require_it_role_in_title: bool = False
    allowed_groups: tuple[str, ...] = ()
    require_confirmed_qualification: bool = False


def has_it_signal(normalized: Column) -> Column:
    return normalized.rlike(rules.IT_SIGNAL)


def has_job_signal(normalized: Column) -> Column:
    return normalized.rlike(rules.JOB_SIGNAL)


def is_state_it(normalized: Column) -> Column:
    return normalized.rlike(rules.TAI)


def is_it_role_title(title: Column) -> Column:
    n = text.normalize(title)
    return n.rlike(rf"\b(?:{rules.ROLE_WORDS})\b.*\b(?:{rules.IT_WORDS})\b") | n.rlike(rules.CORPS_IT) | n.rlike(rules.ANALYST) | is_state_it(n)


def is_region_it(source: Column, organisation: Column, position: Column) -> Column:
    owner = (source == "iaap") | text.contains_any(organisation, rules.OWNER_MARKERS)
    return owner & text.contains_any(position, (*rules.STRONG_IT_TERMS, "opcion informatica"))


def relevance(role: Column, position: Column, whole: Column, region_it: Column) -> Column:
    """Veto of office roles, special posts, strong terms with employment, then two weak substrings with employment."""
    veto = text.contains_any(role, rules.ADMIN_ROLES) & ~text.contains_any(role, rules.ADMIN_EXCEPTIONS)
    employment = text.contains_any(whole, rules.EMPLOYMENT_TERMS)
    strong = text.contains_any(position, rules.STRONG_IT_TERMS)
    weak = F.size(text.hits(position, rules.WEAK_IT_TERMS))
    return ~veto & (is_state_it(position) | region_it | (employment & (strong | (weak >= 2))))


def qualification(raw: Column, standalone: Column) -> Column:
    """COMPATIBLE, REVISAR or NO_COMPATIBLE, by the sentences that state requirements."""
    sentences = F.transform(F.split(text.text(raw), r"[.;\n]", -1), text.normalize)
    required = lambda s: F.filter(s, lambda s: text.contains_any(s, rules.MANDATORY_MARKERS))
    return text.once(sentences, lambda s: text.once(required(s), lambda r: _judged(s, r, standalone)))


def _judged(sentences: Column, required: Column, standalone: Column) -> Column:
    accepted = lambda s: text.contains_any(s, rules.ACCEPTED_QUALIFICATIONS)
    university = lambda s: text.contains_any(s, rules.UNIVERSITY_TERMS)
    either = lambda s: text.contains_any(s, rules.ALTERNATIVE_MARKERS)
    some_accepted = F.exists(required, lambda s: accepted(s) & (~university(s) | either(s)))
    some_mixed = F.exists(required, lambda s: accepted(s) & university(s) & ~either(s))
    some_university = F.exists(required, lambda s: university(s) & ~accepted(s))
    evidence = F.array_join(F.filter(sentences, lambda s: ~text.contains_any(s, rules.MERIT_MARKERS)), " ")
    return (
        F.when(~F.exists(sentences, lambda s: s != ""), rules.REVIEW)
        .when(some_accepted & some_university, rules.REVIEW)
        .when(some_accepted, rules.COMPATIBLE)
        .when(some_mixed, rules.REVIEW)
        .when(some_university, rules.NOT_COMPATIBLE)
        .when(standalone & text.once(evidence, accepted), rules.COMPATIBLE)
        .otherwise(rules.REVIEW)
    )


def evidence_terms(found: Column, most: int = 3) -> Column:
    """The first terms that were found, as one text."""
    return F.array_join(F.slice(found, 1, most), ", ")


def access(normalized: Column) -> Column:
    is_open = text.contains_any(normalized, rules.OPEN_ACCESS)
    internal = F.contains(normalized, F.lit(rules.INTERNAL_ACCESS)) & ~text.contains_any(normalized, rules.NEGATED_INTERNAL)
    return F.when(is_open & internal, rules.MIXED).when(is_open, rules.OPEN).when(internal, rules.INTERNAL_ONLY).otherwise(rules.UNKNOWN_ACCESS)


def status(normalized: Column) -> Column:
    out = F.when(F.lit(False), "")
    for needles, name in rules.STATUS_RULES:
        out = out.when(text.contains_any(normalized, needles), name)
    return out.otherwise(rules.STATUS_OTHERWISE)


def in_area(special: Column, whole: Column, province: Column, locality: Column, profile: Profile) -> Column:
    places = [*profile.priority_places, *profile.nearby_places]
    own = F.trim(F.concat_ws(" ", text.normalize(F.concat_ws(" ", province, locality)), whole))
    return F.coalesce(special.isin("TAI_ESTADO", "JUNTA_INFORMATICA"), F.lit(False)) | text.contains_any(whole, places) | F.contains(own, F.lit(profile.province))


def priority(special: Column, whole: Column, profile: Profile) -> Column:
    return (
        F.when(special.isin("TAI_ESTADO", "JUNTA_INFORMATICA"), 5)
        .when(F.contains(whole, F.lit(profile.city)), 5)
        .when(text.contains_any(whole, profile.priority_places), 4)
        .when(F.contains(whole, F.lit(profile.province)), 3)
        .otherwise(2)
    )


#: Columns that evaluate() reads.
OBSERVED = ("source", "title", "organisation", "summary", "full_text", "locality", "province", "group", "qualification_text", "access", "special_process", "milestone_text", "link_labels")


#: Those of them that are normalised.
TEXTS = ("title", "organisation", "summary", "full_text", "locality", "province", "group", "qualification_text")


def evaluate(df: DataFrame, profile: Profile) -> DataFrame:
    """df with special_process, access, compatibility, status, priority and decision (include, relevant, in_area, reviewable, reason).

    Reviewable is what would be included if the gates that later documents can still meet were off: those of the
    qualification, and that of the group where the group isn't known. Each text column is normalised once, in a column
    of its own; what joins several is made of these. All are dropped again.
    """
    df = df.withColumns({f"_n_{c}": text.normalize(F.col(c)) for c in TEXTS})
    joined = lambda *names: F.concat_ws(" ", *(F.nullif(f"_n_{c}", F.lit("")) for c in names))
    df = df.withColumns(
        {
            "_role": F.col("_n_title"),
            "_org": F.col("_n_organisation"),
            "_pos": joined("title", "summary", "group", "qualification_text"),
            "_whole": joined("title", "organisation", "summary", "full_text", "locality", "province", "qualification_text"),
        }
    ).drop(*(f"_n_{c}" for c in TEXTS))
    own = F.col("milestone_text")
    said = F.when(own != "", text.normalize(own)).otherwise(F.trim(F.concat_ws(" ", "_whole", text.normalize(F.col("link_labels")))))
    df = df.withColumns({"_region": is_region_it(F.col("source"), F.col("_org"), F.col("_pos")), "_said": said})
    special = F.when(F.lit(profile.special_state) & is_state_it(F.col("_pos")), "TAI_ESTADO").when(F.lit(profile.special_region) & F.col("_region"), "JUNTA_INFORMATICA").otherwise(F.col("special_process"))
    judged = F.concat_ws("\n", F.nullif("qualification_text", F.lit("")), F.nullif("full_text", F.lit("")))
    df = df.withColumns(
        {
            "special_process": special,
            "access": F.when(F.coalesce("access", F.lit(rules.UNKNOWN_ACCESS)) == rules.UNKNOWN_ACCESS, access(F.col("_whole"))).otherwise(F.col("access")),
            "_evidence": qualification(judged, text.text(F.col("qualification_text")) != ""),
            "status": status(F.col("_said")),
            "_relevant": relevance(F.col("_role"), F.col("_pos"), F.col("_whole"), F.col("_region")),
        }
    )
    df = df.withColumns(
        {
            "compatibility": F.when(F.col("access") == rules.INTERNAL_ONLY, rules.NOT_COMPATIBLE).otherwise(F.col("_evidence")),
            "_area": in_area(F.col("special_process"), F.col("_whole"), F.col("province"), F.col("locality"), profile),
            "priority": priority(F.col("special_process"), F.col("_whole"), profile),
        }
    )
    wrong = [
        (F.lit(profile.require_it_qualification) & ~(text.contains_any(text.normalize(F.col("qualification_text")), rules.IT_FAMILY_TERMS) | text.normalize(F.col("qualification_text")).rlike(rules.IT_DEGREES)), "las bases no confirman DAM/DAW/ASIR o familia informatica"),
        (F.lit(profile.require_it_role_in_title) & ~is_it_role_title(F.col("title")), "el titulo no identifica un puesto informatico del perfil"),
        (F.lit(bool(profile.allowed_groups)) & ~F.upper(F.trim(text.text(F.col("group")))).isin(*(profile.allowed_groups or ("",))), "grupo no permitido o no confirmado (solo B/C1)"),
        (F.lit(profile.require_confirmed_qualification) & (F.col("compatibility") != rules.COMPATIBLE), "titulacion compatible no confirmada"),
    ]
    noted = [
        (~F.col("_relevant"), "sin senal suficiente de puesto informatico"),
        (~F.col("_area"), "fuera del ambito geografico"),
        (F.col("_evidence") == rules.NOT_COMPATIBLE, "titulacion universitaria obligatoria"),
        (F.col("access") == rules.INTERNAL_ONLY, "promocion interna exclusiva"),
    ]
    gates = F.lit(True)
    for condition, _ in wrong:
        gates = gates & ~condition
    core = F.col("_relevant") & F.col("_area") & (F.col("compatibility") != rules.NOT_COMPATIBLE) & (F.col("access") != rules.INTERNAL_ONLY)
    include, review = core & gates, core & ~wrong[1][0] & ((text.text(F.col("group")) == "") | ~wrong[2][0])
    reason = F.concat_ws("; ", *(F.when(c, r) for c, r in (*wrong, *noted)))
    decision = F.struct(include.alias("include"), F.col("_relevant").alias("relevant"), F.col("_area").alias("in_area"), review.alias("reviewable"), F.when(reason == "", "compatible o requiere revision").otherwise(reason).alias("reason"))
    return df.withColumn("decision", decision).drop("_role", "_org", "_pos", "_whole", "_region", "_said", "_evidence", "_relevant", "_area")


def can_apply(status_: Column, access_: Column, confirmed: Column, deadline: Column, published: Column, today: Column) -> Column:
    open_now = status_.isin(*rules.APPLICABLE_STATUSES) & access_.isin(rules.OPEN, rules.MIXED) & confirmed & (deadline >= today)
    return F.coalesce(open_now & (published.isNull() | (published <= today)), F.lit(False))


def window_open(source: Column, status_: Column, access_: Column, confirmed: Column, published: Column, days: Column, kind: Column, starts_after: Column, today: Column) -> Column:
    """Whether a period that runs from a publication may still be open; an estimate, never a confirmed date."""
    calendar = F.when(kind == "naturales", days).otherwise(F.ceil(days * 7 / 5) + 4)
    own = F.create_map(*(F.lit(v) for kv in rules.OWN_BULLETIN.items() for v in kv))
    margin = F.when((starts_after != "") & (starts_after == F.try_element_at(own, source)), 3).otherwise(20)
    may = ~confirmed & status_.isin(*rules.APPLICABLE_STATUSES) & (access_ != rules.INTERNAL_ONLY) & (published <= today) & (days > 0)
    return F.coalesce(may & (F.datediff(today, published) <= calendar + margin), F.lit(False))


def notify_at_first(deadline: Column, confirmed: Column, exam: Column, published: Column, special: Column, today: Column, age: int) -> Column:
    """Whether the first run notifies: an open confirmed deadline, then a coming exam, then not expired and young or special."""
    return (
        F.when(confirmed & (deadline >= today), True)
        .when(exam >= today, True)
        .when(deadline < today, False)
        .when(published.isNotNull(), F.datediff(today, published) <= age)
        .otherwise(F.coalesce(special != "", F.lit(False)))
    )


def in_window(published: Column, today: Column, lookback: Column, followed: Column, undated: bool, future: bool) -> Column:
    """Whether a record's age is within the window: undated says whether records without a date pass, future whether those ahead of today do; what is followed always does."""
    age = F.datediff(today, published)
    fits = (age <= lookback) & (F.lit(future) | (age >= 0))
    return F.coalesce(followed, F.lit(False)) | F.coalesce(fits, F.lit(undated))


def names_place(quick_text: Column, places: tuple[str, ...]) -> Column:
    """Whether a text names one of the configured places."""
    return text.contains_any(text.normalize(quick_text), places)


def material_notice(title: Column, summary: Column) -> Column:
    """What a notice changes by its wording; null if nothing."""
    n, out = text.normalize(F.concat_ws(" ", title, summary)), F.when(F.lit(False), "")
    for needles, label in rules.NOTICE_CHANGES:
        out = out.when(text.contains_any(n, needles), label)
    return out


def schedule_gate(cron_hour: Column, run_at: Column, zone: str = "Europe/Madrid", hour: int = 8) -> Column:
    """Whether a nominal UTC hour falls on the local hour that day; an unknown one passes."""
    nominal = F.date_trunc("day", run_at) + F.make_dt_interval(hours=F.coalesce(cron_hour, F.lit(0)))
    return cron_hour.isNull() | (F.hour(F.from_utc_timestamp(nominal, zone)) == hour)
