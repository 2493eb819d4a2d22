"""The engine's queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge.functions import classify, extract, identity, rules, text
from noticeforge.operators import collect, merge, outbox, resolve, scratch, upsert, views
from noticeforge.plans.observations import SELECT, observations
from noticeforge.sources import html, splitter

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PROFILE = classify.Profile()
TODAY = date(1998, 1, 1)
TODAY_SQL = f"DATE '{TODAY}'"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table that the processor bounds, dealt out where it has fewer files than there are cores; a large one is read as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# --- SQL pieces for DuckDB -------------------------------------------------------

OBS = f"obs AS ({SELECT})"


def n_(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def any_(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def rx(p: str) -> str:
    return p.replace("'", "''")


WHOLE = "concat_ws(' ', nullif(title, ''), nullif(organisation, ''), nullif(summary, ''), nullif(full_text, ''), nullif(locality, ''), nullif(province, ''), nullif(qualification_text, ''))"
POSITION = "concat_ws(' ', nullif(title, ''), nullif(summary, ''), nullif(\"group\", ''), nullif(qualification_text, ''))"
STATUS_SQL = "CASE " + " ".join(f"WHEN {any_('n', needles)} THEN '{name}'" for needles, name in rules.STATUS_RULES) + f" ELSE '{rules.STATUS_OTHERWISE}' END"
ACCESS_SQL = f"CASE WHEN {any_('n', rules.OPEN_ACCESS)} AND contains(n, 'promocion interna') AND NOT {any_('n', rules.NEGATED_INTERNAL)} THEN '{rules.MIXED}' WHEN {any_('n', rules.OPEN_ACCESS)} THEN '{rules.OPEN}' WHEN contains(n, 'promocion interna') AND NOT {any_('n', rules.NEGATED_INTERNAL)} THEN '{rules.INTERNAL_ONLY}' ELSE '{rules.UNKNOWN_ACCESS}' END"
NORM = f"base AS (SELECT *, {n_(WHOLE)} AS n, {n_(POSITION)} AS pos, {n_('title')} AS role, {n_('organisation')} AS org FROM obs)"
REGION_SQL = f"((source = 'iaap' OR {any_('org', rules.OWNER_MARKERS)}) AND {any_('pos', (*rules.STRONG_IT_TERMS, 'opcion informatica'))})"
TAI_SQL = f"regexp_matches(pos, '{rx(rules.TAI)}')"
WEAK_SQL = "(" + " + ".join(f"contains(pos, '{w}')::int" for w in rules.WEAK_IT_TERMS) + ")"
RELEVANT_SQL = f"(NOT ({any_('role', rules.ADMIN_ROLES)} AND NOT {any_('role', rules.ADMIN_EXCEPTIONS)}) AND ({TAI_SQL} OR {REGION_SQL} OR ({any_('n', rules.EMPLOYMENT_TERMS)} AND ({any_('pos', rules.STRONG_IT_TERMS)} OR {WEAK_SQL} >= 2))))"
SPECIAL_SQL = f"CASE WHEN {TAI_SQL} THEN 'TAI_ESTADO' WHEN {REGION_SQL} THEN 'JUNTA_INFORMATICA' ELSE '' END"
AREA_SQL = f"({SPECIAL_SQL} <> '' OR {any_('n', [*PROFILE.priority_places, *PROFILE.nearby_places, PROFILE.province])})"
PRIORITY_SQL = f"CASE WHEN {SPECIAL_SQL} <> '' THEN 5 WHEN contains(n, '{PROFILE.city}') THEN 5 WHEN {any_('n', PROFILE.priority_places)} THEN 4 WHEN contains(n, '{PROFILE.province}') THEN 3 ELSE 2 END"
JUDGED = "concat_ws(chr(10), nullif(qualification_text, ''), nullif(full_text, ''))"
QUALIFIED = f"""
sent AS (SELECT seq, qualification_text, {n_(JUDGED)} AS all_n, list_transform(regexp_split_to_array({JUDGED}, '[.;\\n]'), lambda s: {n_('s')}) AS ss FROM obs),
flags AS (SELECT seq, all_n, qualification_text,
    list_filter(ss, lambda s: {any_('s', rules.MANDATORY_MARKERS)}) AS req,
    array_to_string(list_filter(ss, lambda s: NOT {any_('s', rules.MERIT_MARKERS)}), ' ') AS ev FROM sent),
judged AS (SELECT seq, CASE WHEN all_n = '' THEN 'REVISAR'
    WHEN acc AND uni THEN 'REVISAR' WHEN acc THEN 'COMPATIBLE' WHEN mix THEN 'REVISAR' WHEN uni THEN 'NO_COMPATIBLE'
    WHEN qualification_text <> '' AND {any_('ev', rules.ACCEPTED_QUALIFICATIONS)} THEN 'COMPATIBLE' ELSE 'REVISAR' END AS compatibility
  FROM (SELECT *,
    len(list_filter(req, lambda s: {any_('s', rules.ACCEPTED_QUALIFICATIONS)} AND (NOT {any_('s', rules.UNIVERSITY_TERMS)} OR {any_('s', rules.ALTERNATIVE_MARKERS)}))) > 0 AS acc,
    len(list_filter(req, lambda s: {any_('s', rules.ACCEPTED_QUALIFICATIONS)} AND {any_('s', rules.UNIVERSITY_TERMS)} AND NOT {any_('s', rules.ALTERNATIVE_MARKERS)})) > 0 AS mix,
    len(list_filter(req, lambda s: {any_('s', rules.UNIVERSITY_TERMS)} AND NOT {any_('s', rules.ACCEPTED_QUALIFICATIONS)})) > 0 AS uni FROM flags))
"""


# --- normalisation and extraction ------------------------------------------------


@query(f"SELECT status, count(*) AS n, CAST(sum(signal) AS BIGINT) AS signals FROM (SELECT {STATUS_SQL} AS status, regexp_matches(n, '{rx(rules.JOB_SIGNAL)}')::int AS signal FROM (SELECT {n_('text')} AS n FROM documents)) GROUP BY status")
def normalize_status_counts(spark, sf_dir):
    n = dealt(read(spark, sf_dir, "documents").select("text")).select(text.normalize(F.col("text")).alias("n"))
    return n.groupBy(classify.status(F.col("n")).alias("status")).agg(F.count("*").alias("n"), F.count_if(classify.has_job_signal(F.col("n"))).alias("signals"))


flagship = normalize_status_counts


@query(f"SELECT doc_id, md5({n_('text')}) AS norm, md5(trim(regexp_replace(text, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2028}}\\x{{2029}}\\x0b]+', ' ', 'g'))) AS clean FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm"), F.md5(text.clean(F.col("text"))).alias("clean"))


@query(f"WITH {OBS} SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({n_('title')}, '{rx(rules.GENERIC_TITLE_WORDS)}', ' ', 'g'), '{rules.TITLE_YEARS}', ' ', 'g'), '{rules.TITLE_NUMBERS}', ' ', 'g'), ' +', ' ', 'g')) AS signature, regexp_extract(title, '{rules.YEAR}', 1) AS year, regexp_replace(upper(strip_accents(summary)), '[^A-Z0-9]', '', 'g') AS reference FROM obs")
def title_signature(spark, sf_dir):
    return observations(spark, sf_dir).select("seq", text.title_signature(F.col("title")).alias("signature"), text.extract_year(F.col("title")).alias("year"), text.normalize_reference(F.col("summary")).alias("reference"))


_MIXED_DATE = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN 'el ' || strftime(o_orderdate, '%d/%m/%Y') || ' a las 9' ELSE '31/02/' || strftime(o_orderdate, '%Y') END"


@query(f"SELECT o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%d-%m-%Y'), CASE WHEN regexp_matches(t, '^\\d{{8}}$') THEN try_strptime(t, '%Y%m%d') END, try_strptime(regexp_extract(t, '(\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}})', 1), '%d/%m/%Y'))::DATE AS parsed FROM (SELECT o_orderkey, {_MIXED_DATE} AS t FROM orders)")
def parse_date_multi(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).when(k == 3, F.date_format(d, "yyyyMMdd"))
    t = t.when(k == 4, F.concat(F.lit("el "), F.date_format(d, "dd/MM/yyyy"), F.lit(" a las 9"))).otherwise(F.concat(F.lit("31/02/"), F.date_format(d, "yyyy")))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(t).alias("parsed"))


@query("SELECT c_custkey, sha256('{\"balance\":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',\"name\":' || to_json(c_name) || ',\"nation\":' || to_json(n_name) || '}') AS hash, sha256('\"' || c_name || '\"') AS name_hash FROM customer JOIN nation ON c_nationkey = n_nationkey")
def canonical_hash(spark, sf_dir):
    both = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    json = text.canonical_json(F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))
    return both.select("c_custkey", text.stable_hash(json).alias("hash"), text.string_hash(F.col("c_name")).alias("name_hash"))


@query(f"WITH {OBS} SELECT seq, regexp_matches(n, '{rx(rules.IT_SIGNAL)}') AS it, regexp_matches(n, '{rx(rules.JOB_SIGNAL)}') AS job FROM (SELECT seq, {n_(WHOLE)} AS n FROM obs)")
def signal_filter(spark, sf_dir):
    o = observations(spark, sf_dir).select("seq", text.normalize(text.searchable(*_WHOLE)).alias("n"))
    return o.select("seq", classify.has_it_signal(F.col("n")).alias("it"), classify.has_job_signal(F.col("n")).alias("job"))


_WHOLE = ("title", "organisation", "summary", "full_text", "locality", "province", "qualification_text")


@query(f"WITH {OBS} SELECT seq, CASE WHEN p > 0 THEN trim(substring(n, greatest(p - 121, 0) + 1, p - 1 + length(m) + 260 - greatest(p - 121, 0))) ELSE '' END AS excerpt FROM (SELECT seq, n, m, CASE WHEN m = '' THEN 0 ELSE strpos(n, m) END AS p FROM (SELECT seq, n, regexp_extract(n, '{rx(rules.IT_SIGNAL)}') AS m FROM (SELECT seq, {n_(WHOLE)} AS n FROM obs)))")
def signal_excerpt(spark, sf_dir):
    return observations(spark, sf_dir).select("seq", extract.signal_excerpt(text.searchable(*_WHOLE)).alias("excerpt"))


@query(f"""WITH {OBS} SELECT seq,
  CASE WHEN g <> '' THEN upper(g) WHEN c LIKE 'b%' THEN 'B' ELSE upper(c) END AS found_group,
  coalesce(try_cast(nullif(p1, '') AS INTEGER), try_cast(nullif(p2, '') AS INTEGER)) AS positions, refs
FROM (SELECT seq, regexp_extract(n, '{rules.GROUP}', 1) AS g, regexp_extract(n, '{rules.CORPS}', 1) AS c,
  regexp_extract(n, '{rules.POSITIONS[0]}', 1) AS p1, regexp_extract(n, '{rules.POSITIONS[1]}', 1) AS p2,
  array_to_string(list_concat(regexp_extract_all(full_text, 'BOE-[AB]-[0-9]+-[0-9]+'), regexp_extract_all(full_text, 'BOP[- ][0-9]+[- ][0-9]+')), ' ') AS refs
  FROM (SELECT seq, full_text, {n_(WHOLE)} AS n FROM obs))""".replace("refs\nFROM (SELECT seq, regexp_extract", "replace(refs, '-', '') AS refs\nFROM (SELECT seq, regexp_extract"))
def extract_fields(spark, sf_dir):
    whole = text.searchable(*_WHOLE)
    return observations(spark, sf_dir).select("seq", extract.group(whole).alias("found_group"), extract.positions(whole).alias("positions"), F.array_join(extract.references(F.col("full_text")), " ").alias("refs"))


@query(f"WITH {OBS} SELECT seq, publication_date AS deadline, true AS confirmed, publication_date AS exam_date, '09:30' AS exam_time, 'Aula Magna' AS exam_place, false AS provisional FROM obs")
def extract_dates(spark, sf_dir):
    """The sentence's deadline and examination, not the resolution's date after them. What look-behind decides is tested by cases."""
    o = observations(spark, sf_dir)
    day = F.date_format("publication_date", "dd/MM/yyyy")
    t = F.concat(F.lit("Plazo de presentación hasta el "), day, F.lit(". El examen se celebrará el "), day, F.lit(" a las 9:30 en lugar: Aula Magna. Resolución de 01/01/2020."))
    o = o.select("seq", t.alias("t")).withColumn("d", extract.deadline(F.col("t")))
    t = F.col("t")
    return o.select("seq", F.col("d.date").alias("deadline"), F.col("d.confirmed").alias("confirmed"), extract.exam_date(t).alias("exam_date"), extract.exam_time(t).alias("exam_time"), extract.exam_place(t).alias("exam_place"), extract.exam_is_provisional(t).alias("provisional"))


# --- classification --------------------------------------------------------------


def _observed(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).withColumns({"access": F.lit(rules.UNKNOWN_ACCESS), "special_process": F.lit(""), "milestone_text": F.lit(""), "link_labels": F.lit("")})


@query(f"WITH {OBS}, {NORM} SELECT seq, {RELEVANT_SQL} AS relevant, {ACCESS_SQL} AS access, {PRIORITY_SQL} AS priority, {AREA_SQL} AS in_area, {STATUS_SQL} AS status FROM base")
def classify_observations(spark, sf_dir):
    e = classify.evaluate(_observed(spark, sf_dir), PROFILE)
    return e.select("seq", F.col("decision.relevant").alias("relevant"), "access", "priority", F.col("decision.in_area").alias("in_area"), "status")


@query(f"WITH {OBS}, {QUALIFIED} SELECT seq, compatibility FROM judged")
def qualification_sentences(spark, sf_dir):
    o = observations(spark, sf_dir)
    judged = F.concat_ws("\n", F.nullif("qualification_text", F.lit("")), F.nullif("full_text", F.lit("")))
    return o.select("seq", classify.qualification(judged, F.col("qualification_text") != "").alias("compatibility"))


@query(f"""WITH {OBS}, {NORM}, {QUALIFIED}, x AS (SELECT base.seq, {RELEVANT_SQL} AS relevant, {AREA_SQL} AS area, {ACCESS_SQL} AS access, compatibility AS evidence FROM base JOIN judged USING (seq))
SELECT seq, relevant AND area AND access <> 'PROMOCION_INTERNA_EXCLUSIVA' AND evidence <> 'NO_COMPATIBLE' AS include,
  coalesce(nullif(concat_ws('; ', CASE WHEN NOT relevant THEN 'sin senal suficiente de puesto informatico' END, CASE WHEN NOT area THEN 'fuera del ambito geografico' END,
  CASE WHEN evidence = 'NO_COMPATIBLE' THEN 'titulacion universitaria obligatoria' END, CASE WHEN access = 'PROMOCION_INTERNA_EXCLUSIVA' THEN 'promocion interna exclusiva' END), ''), 'compatible o requiere revision') AS reason FROM x""")
def decision_reasons(spark, sf_dir):
    return classify.evaluate(_observed(spark, sf_dir), PROFILE).select("seq", F.col("decision.include").alias("include"), F.col("decision.reason").alias("reason"))


_DEADLINE = "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER)"


@query(f"""SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderstatus IN ('O', 'P') AND {_DEADLINE} >= {TODAY_SQL} AND CAST(o_orderdate AS DATE) <= {TODAY_SQL} AS applicable,
  o_orderkey % 3 = 0 AND o_orderstatus IN ('O', 'P') AND CAST(o_orderdate AS DATE) <= {TODAY_SQL} AND date_diff('day', CAST(o_orderdate AS DATE), {TODAY_SQL}) <= CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 32 END + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 20 END AS may_be_open FROM orders""")
def can_apply(spark, sf_dir):
    k, published = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    status = F.when(F.col("o_orderstatus").isin("O", "P"), "PLAZO_ABIERTO").otherwise("PLAZO_CERRADO")
    deadline, confirmed, today = F.date_add(published, (k % 40).cast("int")), k % 3 != 0, F.lit(TODAY)
    kind, source = F.when(k % 2 == 0, "naturales").otherwise("habiles"), F.when(k % 5 == 0, "boe").otherwise("martos")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        classify.can_apply(status, F.lit(rules.OPEN), confirmed, deadline, published, today).alias("applicable"),
        classify.window_open(source, status, F.lit(rules.OPEN), confirmed, published, F.lit(20), kind, F.lit("BOE"), today).alias("may_be_open"),
    )


@query(f"WITH {OBS} SELECT seq, list_filter(['martos', 'torredelcampo', 'torredonjimeno', 'jaen', 'granada'], lambda p: contains({n_(WHOLE)}, p))[1] AS place FROM obs")
def location_theta(spark, sf_dir):
    n = text.normalize(text.searchable(*_WHOLE))
    return observations(spark, sf_dir).select("seq", F.get(text.hits(n, ["martos", "torredelcampo", "torredonjimeno", "jaen", "granada"]), 0).alias("place"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d{6,12}:[A-Za-z0-9_-]{30,}\\b', '<redacted>', 'g'), '(?i)(bearer\\s+)[A-Za-z0-9._~+/=-]{8,}', '\\1<redacted>', 'g'), '(?i)(authorization[''\"]?\\s*[:=]\\s*[''\"]?)[^''\"\\s,}]{8,}', '\\1<redacted>', 'g'), '/bot[^/\\s]{20,}/', '<redacted>', 'g')) AS masked FROM documents")
def redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact_secrets(F.col("text"))).alias("masked"))


@query("SELECT event_id, hour(timezone('Europe/Madrid', timezone('UTC', date_trunc('day', ts) + INTERVAL 1 HOUR * (6 + event_id % 3)))) = 8 AS runs FROM events")
def schedule_gate(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", classify.schedule_gate((6 + F.col("event_id") % 3).cast("int"), F.col("ts")).alias("runs"))


# --- joins and identity ----------------------------------------------------------


_ALIASES = "a AS (SELECT c_custkey AS alias_id, c_custkey - c_custkey % 10 AS process_id FROM customer WHERE c_custkey % 10 <> 0)"


def _aliases(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(k % 10 != 0).select(k.alias("alias_id"), (k - k % 10).alias("process_id"))


@query(f"WITH {_ALIASES} SELECT l_orderkey * 10 + l_linenumber AS seq, coalesce(process_id, o_custkey) AS process_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN a ON o_custkey = alias_id")
def exact_resolution(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("x").alias("source"), F.col("l_orderkey").alias("external_id"))
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("external_id"), F.lit("x").alias("source"), F.col("o_custkey").alias("process_id"))
    return resolve.by_item(lines, items, _aliases(spark, sf_dir))


_REFS = f"refs AS (SELECT 'BOEA' || CAST(2018 + o_orderkey % 9 AS VARCHAR) || CAST(o_orderkey % 700 AS VARCHAR) AS reference, o_orderkey AS process_id, o_orderdate AS first_seen FROM orders)"


@query(f"WITH {OBS}, {_REFS} SELECT seq, arg_min(process_id, (first_seen, process_id)) AS process_id FROM (SELECT seq, 'BOEA' || CAST(2018 + seq % 9 AS VARCHAR) || CAST(seq % 700 AS VARCHAR) AS reference FROM obs) JOIN refs USING (reference) GROUP BY seq")
def reference_resolution(spark, sf_dir):
    refs = read(spark, sf_dir, "orders").select(F.concat(F.lit("BOEA"), (2018 + F.col("o_orderkey") % 9).cast("string"), (F.col("o_orderkey") % 700).cast("string")).alias("reference"), F.col("o_orderkey").alias("process_id"), F.col("o_orderdate").alias("first_seen"))
    first = refs.groupBy("reference").agg(F.min_by(F.struct("process_id", "first_seen"), F.struct("first_seen", "process_id")).alias("x")).select("reference", "x.*")
    o = observations(spark, sf_dir).select("seq", extract.references(F.col("full_text")).alias("references"))
    return resolve.by_reference(o, first)


_KEYED = f"""keyed AS (SELECT seq, source, sha256('{{"access":"REVISAR","group":' || to_json({n_('"group"')}) || ',"organisation":' || to_json({n_('organisation')}) || ',"position":' || to_json(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({n_('title')}, '{rx(rules.GENERIC_TITLE_WORDS)}', ' ', 'g'), '{rules.TITLE_YEARS}', ' ', 'g'), '{rules.TITLE_NUMBERS}', ' ', 'g'), ' +', ' ', 'g'))) || ',"year":' || to_json(coalesce(nullif(regexp_extract(CAST(publication_date AS VARCHAR), '{rules.YEAR}', 1), ''), regexp_extract(title, '{rules.YEAR}', 1))) || '}}') AS canonical_key FROM obs)"""


@query(f"WITH {OBS}, {_KEYED} SELECT canonical_key, count(*) AS n, min(seq) AS first_seq, count(DISTINCT source) AS sources FROM keyed GROUP BY canonical_key")
def canonical_group(spark, sf_dir):
    o = observations(spark, sf_dir)
    key = identity.canonical_key(F.col("organisation"), F.col("title"), F.col("publication_date"), F.lit(rules.UNKNOWN_ACCESS), F.col("group"))
    return o.select("seq", "source", key.alias("canonical_key")).groupBy("canonical_key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.count_distinct("source").alias("sources"))


@query(f"WITH {OBS}, {_KEYED} SELECT a.seq FROM keyed a WHERE NOT EXISTS (SELECT 1 FROM keyed b WHERE a.canonical_key = b.canonical_key AND a.source = b.source AND a.seq <> b.seq)")
def conflict_anti(spark, sf_dir):
    o = observations(spark, sf_dir)
    key = identity.canonical_key(F.col("organisation"), F.col("title"), F.col("publication_date"), F.lit(rules.UNKNOWN_ACCESS), F.col("group"))
    # Rows meet the spans of the same rows: their keys are made once.
    keyed = scratch.cut(o.select("seq", "source", key.alias("canonical_key")), "keyed")
    rows = keyed.select("seq", "source", F.col("seq").alias("external_id"), F.col("canonical_key").alias("process_id"))
    return resolve.without_conflict(rows, rows.select("source", "external_id", "process_id")).select("seq")


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence in DuckDB: a row of the table for each character of a, a cell for each of b."""
    cells = f"list_reduce(list_concat([[0]], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda row, c: list_append(row, CASE WHEN {a}[e[1]] = {b}[c[1]] THEN prev[c[1]] + 1 ELSE greatest(row[c[1]], prev[c[1] + 1]) END))"
    return f"list_reduce(list_concat([list_transform(range(len({b}) + 1), lambda j: 0::BIGINT)], list_transform(range(1, len({a}) + 1), lambda i: [i])), lambda prev, e: {cells})[len({b}) + 1]"


def _indel(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 100 WHEN len({a}) * len({b}) = 0 THEN 0 ELSE 200::DOUBLE * {_lcs(a, b)} / (len({a}) + len({b})) END"


_SIGNED = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({n_('p_name')}, '{rx(rules.GENERIC_TITLE_WORDS)}', ' ', 'g'), '{rules.TITLE_YEARS}', ' ', 'g'), '{rules.TITLE_NUMBERS}', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, p_size, list_sort(list_distinct(list_filter(string_split({_SIGNED}, ' '), lambda t: t <> ''))) AS tokens FROM part),
old AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS place FROM p WHERE p_partkey % 2 = 1),
pairs AS (SELECT n.p_partkey AS seq, o.p_partkey AS process_id, o.place, len(n.tokens) * len(o.tokens) AS both_any, list_filter(n.tokens, lambda t: list_contains(o.tokens, t)) AS b, list_filter(n.tokens, lambda t: NOT list_contains(o.tokens, t)) AS l, list_filter(o.tokens, lambda t: NOT list_contains(n.tokens, t)) AS r
  FROM p n JOIN old o ON o.p_brand = n.p_brand AND o.p_size = n.p_size AND o.place <= 100 WHERE n.p_partkey % 2 = 0),
texts AS (SELECT *, array_to_string(b, ' ') AS x, trim(array_to_string(list_concat(b, l), ' ')) AS y, trim(array_to_string(list_concat(b, r), ' ')) AS z FROM pairs),
scores AS (SELECT seq, process_id, place, CASE WHEN both_any = 0 THEN 0 WHEN len(b) > 0 AND len(l) * len(r) = 0 THEN 100 ELSE greatest({_indel('y', 'z')}, CASE WHEN len(b) > 0 THEN greatest({_indel('x', 'y')}, {_indel('x', 'z')}) ELSE 0 END) END / 100::DOUBLE AS score FROM texts)
SELECT seq, arg_min(process_id, (-score, place)) AS process_id, round(max(score), 6) AS score FROM scores WHERE score >= 0.5 GROUP BY seq""")
def fuzzy_block_top1(spark, sf_dir):
    """Parts against the newest hundred of their brand: the similar title of the same size, in the engine's own cascade stage."""
    p = read(spark, sf_dir, "part")
    sides = {"year": F.lit(""), "group": F.col("p_size").cast("string"), "access": F.lit(rules.UNKNOWN_ACCESS), "positions": F.lit(None).cast("int"), "organisation": F.col("p_brand"), "signature": text.title_signature(F.col("p_name"))}
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("seq"), F.lit("a").alias("source"), F.col("p_partkey").cast("string").alias("external_id"), *(c.alias(k) for k, c in sides.items()))
    old = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("last_seen"), *(c.alias(k) for k, c in sides.items()))
    items = old.select(F.lit("b").alias("source"), F.col("id").cast("string").alias("external_id"), F.col("id").alias("process_id"))
    return resolve.by_title(new, old, items, least=0.5).select("seq", "process_id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS ever_sent, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_anti_left(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    sent = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("ever_sent", F.lit(True))
    left = c.join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(sent, "c_custkey", "left")
    return left.join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("ever_sent", F.lit(False)).alias("ever_sent"), F.col("n_name").alias("nation"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS heading, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def asof_heading(spark, sf_dir):
    e = views.carry(read(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "click", F.col("value")), "heading")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "heading", F.coalesce(F.lead("event_id").over(w), F.lit(0)).alias("next_id"))


@query(f"WITH {_ALIASES} SELECT o_orderkey, coalesce(process_id, o_custkey) AS canonical FROM orders LEFT JOIN a ON o_custkey = alias_id")
def alias_resolve(spark, sf_dir):
    return resolve.follow_alias(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("canonical")), _aliases(spark, sf_dir), "canonical")


@query("WITH h AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS id FROM customer), p AS (SELECT c_custkey AS asked, substr(md5(CAST(c_custkey AS VARCHAR)), 1, CAST(6 + c_custkey % 5 AS INTEGER)) AS prefix FROM customer) SELECT asked, prefix, min(h.id) AS id FROM p JOIN h ON substr(h.id, 1, 8) = substr(prefix, 1, 8) AND starts_with(h.id, prefix) WHERE regexp_matches(prefix, '^[0-9a-f-]{8,36}$') GROUP BY ALL HAVING count(*) = 1")
def prefix_lookup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("id"))
    return resolve.by_prefix(c.select(F.col("c_custkey").alias("asked"), F.substring("id", F.lit(1), (6 + F.col("c_custkey") % 5).cast("int")).alias("prefix")), c)


# --- aggregates, windows, top-k --------------------------------------------------


@query("SELECT 'outbox_' || lower(o_orderstatus) AS key, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY o_orderstatus")
def stats_by_status(spark, sf_dir):
    box = read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return views.status_counts(box, "outbox", F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("WITH r AS (SELECT user_id AS source, max(event_id) AS id FROM events GROUP BY user_id), c AS (SELECT user_id AS source, max(CAST(ts AS DATE)) AS covered FROM events WHERE event_type <> 'error' AND event_id % 3 = 0 GROUP BY user_id) SELECT r.source, id, event_type AS status, covered AS covered_through FROM r JOIN events ON event_id = id LEFT JOIN c ON c.source = r.source")
def source_status(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.lit(0).alias("found"))
    done = e.where("event_type <> 'error' and event_id % 3 = 0").select(F.col("user_id").alias("source"), F.lit("OK").alias("status"), F.col("ts").cast("date").alias("covered_through"))
    checkpoints = upsert.checkpoint_max(done.limit(0), done)
    return views.source_status(runs, checkpoints).select("source", "id", "status", "covered_through")


@query("SELECT source, attempted, errors, warnings, attempted - errors - warnings AS healthy, CASE WHEN errors >= attempted THEN 'NO_SOURCES' WHEN errors > 0 OR warnings > 0 THEN 'PARTIAL' ELSE 'OK' END AS outcome FROM (SELECT user_id % 50 AS source, count(*) AS attempted, count(*) FILTER (event_id % 11 = 0) AS errors, count(*) FILTER (event_id % 13 = 0 AND event_id % 11 <> 0) AS warnings FROM events GROUP BY 1)")
def run_outcome(spark, sf_dir):
    k = F.col("event_id")
    a = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("source")).agg(F.count("*").alias("attempted"), F.count_if(k % 11 == 0).alias("errors"), F.count_if((k % 13 == 0) & (k % 11 != 0)).alias("warnings"))
    cols = F.col("attempted"), F.col("errors"), F.col("warnings")
    return a.select("source", "attempted", "errors", "warnings", views.healthy(*cols).alias("healthy"), views.outcome(*cols).alias("outcome"))


@query("SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def history_top10(spark, sf_dir):
    return views.latest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "rank")


@query("SELECT c_custkey, c_name, CAST(3 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM customer) / 5.0) AS BIGINT) AS pages FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
def paging(spark, sf_dir):
    return views.page(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 3)


@query("SELECT text_hash, doc_id FROM (SELECT md5(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id")
    return upsert.first_seen(d, ["text_hash"], ["doc_id"]).select("text_hash", "doc_id")


@query("SELECT s AS start, least(s + 9, hi) AS stop FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 10 DAY)) AS DATE) AS s, hi FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))")
def windows_split(spark, sf_dir):
    span = read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return span.select(F.explode(views.windows(F.col("lo"), F.col("hi"), 10)).alias("w")).select("w.*")


@query(f"SELECT o_custkey, CAST(least(asked, 45) AS INTEGER) AS days, CAST(greatest(asked - 45, 0) AS INTEGER) AS gap FROM (SELECT o_custkey, greatest(date_diff('day', CAST(max(o_orderdate) AS DATE), {TODAY_SQL}), 0) + 2 AS asked FROM orders GROUP BY o_custkey)")
def window_plan(spark, sf_dir):
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("c"))
    return last.select("o_custkey", views.lookback(F.col("c"), F.lit(TODAY), 2, 14, 45).alias("x")).select("o_custkey", F.col("x.days").cast("int").alias("days"), F.col("x.gap").cast("int").alias("gap"))


# --- state and delivery ----------------------------------------------------------

_OUT = "SELECT event_id, CAST(ts AS TIMESTAMP) AS created_at, CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRYABLE' WHEN 2 THEN 'SENDING' WHEN 3 THEN 'SENT' ELSE 'SUPPRESSED' END AS status, CAST(event_id % 8 AS INTEGER) AS attempts FROM events"


def _outbox(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 5 == 0, "PENDING").when(k % 5 == 1, "RETRYABLE").when(k % 5 == 2, "SENDING").when(k % 5 == 3, "SENT").otherwise("SUPPRESSED")
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), status.alias("status"), (k % 8).cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("message_id"), F.col("ts").alias("claimed_at"))


@query(f"SELECT event_id, 'SENDING' AS status, attempts + 1 AS attempts FROM ({_OUT}) WHERE status = 'PENDING' OR (status = 'RETRYABLE' AND attempts < 5) ORDER BY created_at, event_id LIMIT 20")
def outbox_claim(spark, sf_dir):
    return outbox.claim(_outbox(spark, sf_dir), 20).select("event_id", "status", "attempts")


@query(f"SELECT status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT CASE WHEN status = 'SENDING' AND event_id % 3 = 0 THEN 'PENDING' WHEN status = 'SENDING' AND created_at < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE THEN 'UNCERTAIN' WHEN status = 'SUPPRESSED' AND event_id % 7 = 0 THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'SENDING' AND event_id % 3 = 0 THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts FROM ({_OUT})) GROUP BY status")
def outbox_transitions(spark, sf_dir):
    o = _outbox(spark, sf_dir)
    now = o.agg(F.max("created_at").alias("now"))
    o = outbox.release(o, F.col("event_id") % 3 == 0).join(F.broadcast(now))
    o = outbox.retry(outbox.recover_stale(o, F.col("now")), (F.col("event_id") % 7 == 0) & (F.col("status") == "SUPPRESSED"))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS process_id, {_DEADLINE} AS deadline, CAST(date_diff('day', {TODAY_SQL}, {_DEADLINE}) AS INTEGER) AS days_before, 'reminder:' || CAST(o_orderkey AS VARCHAR) || ':' || strftime({_DEADLINE}, '%Y-%m-%d') || ':' || CAST(date_diff('day', {TODAY_SQL}, {_DEADLINE}) AS VARCHAR) AS event_key FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'F' AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND date_diff('day', {TODAY_SQL}, {_DEADLINE}) IN (7, 3, 1) AND o_orderkey % 5 <> 0")
def reminders(spark, sf_dir):
    k = F.col("o_orderkey")
    p = read(spark, sf_dir, "orders").select(k.alias("id"), F.date_add(F.col("o_orderdate").cast("date"), (k % 40).cast("int")).alias("deadline"), (k % 3 != 0).alias("deadline_confirmed"), F.when(F.col("o_orderstatus") == "F", "PLAZO_CERRADO").otherwise("PLAZO_ABIERTO").alias("status"), F.when(k % 11 == 0, rules.NOT_COMPATIBLE).otherwise(rules.REVIEW).alias("compatibility"), F.when(k % 13 == 0, rules.INTERNAL_ONLY).otherwise(rules.OPEN).alias("access"))
    made = p.where("id % 5 = 0").select(F.col("id").alias("process_id"), "deadline", F.datediff("deadline", F.lit(TODAY)).alias("days_before"))
    return outbox.reminders(p, made, F.lit(TODAY), [7, 3, 1])


@query("SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.last_value, o.last_value) AS last_value, coalesce(o.first_event, n.first_event) AS first_event FROM (SELECT user_id, max(value) AS last_value, min(event_id) AS first_event FROM events WHERE event_id % 2 = 0 GROUP BY user_id) o FULL JOIN (SELECT user_id, max(value) AS last_value, min(event_id) AS first_event FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY user_id) n ON o.user_id = n.user_id")
def upsert_monotone(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    side = lambda cond: e.where(cond).groupBy("user_id").agg(F.max("value").alias("last_value"), F.min("event_id").alias("first_event"))
    return upsert.upsert(side("event_id % 2 = 0"), side("event_id % 2 = 1 and user_id % 3 <> 0"), ["user_id"], ["first_event"])


@query("SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, min(event_id) FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = e.user_id AND o.event_type = e.event_type) GROUP BY ALL)")
def insert_ignore(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old = upsert.first_seen(e.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])
    return upsert.insert_ignore(old, e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


_CAT_SQL = "CASE WHEN o_orderstatus = 'F' OR (o_orderkey % 4 = 0 AND o_custkey % 10 = 0) THEN 'TRACKING' WHEN o_orderkey % 4 <> 0 AND o_totalprice > 100000 THEN 'OPEN' WHEN o_totalprice > 100000 OR o_orderkey % 3 = 0 THEN 'REVIEW' ELSE 'TRACKING' END"


@query(f"SELECT o_orderkey, {_CAT_SQL} AS category FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_custkey % 10 <> 0)")
def catalog_category(spark, sf_dir):
    include, followed = F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 10 == 0
    status = F.when(F.col("o_orderstatus") == "F", "FINALIZADA").otherwise("PLAZO_ABIERTO")
    c = views.category(include, F.col("o_totalprice") > 100000, F.col("o_orderkey") % 3 != 0, status, ~include & followed)
    return read(spark, sf_dir, "orders").where(include | followed).select("o_orderkey", c.alias("category"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(o_orderkey) OVER w AS k0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus IS DISTINCT FROM s0 THEN 'estado del proceso' END, CASE WHEN o_orderpriority IS DISTINCT FROM p0 THEN 'prioridad' END) AS changes FROM o WHERE k0 IS NOT NULL")
def change_fields(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", *(F.lag(c).over(w).alias(a) for c, a in (("o_orderstatus", "s0"), ("o_orderpriority", "p0"), ("o_orderkey", "k0")))).where("k0 is not null")
    changes = identity.changed_fields({"status": F.col("s0"), "priority": F.col("p0")}, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})
    return o.select("o_orderkey", F.concat_ws("; ", changes).alias("changes"))


_EV_STATUS = ["DETECTADA", "CONVOCADA", "PLAZO_ABIERTO", "ADMITIDOS_PROVISIONAL", "SUSPENDIDA", "REABIERTA", "NOTAS"]


_RANK_SQL = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in rules.STATUS_RANK.items()) + " ELSE 0 END"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)


@query(f"""SELECT user_id, count(*) AS n, list_reduce(list_prepend('{rules.STATUS_OTHERWISE}', list(status ORDER BY ts, event_id)), lambda a, b:
  CASE WHEN b IN ({_IN(rules.EXCEPTIONAL_STATUSES)}) THEN b WHEN a IN ({_IN(rules.EXCEPTIONAL_STATUSES)}) THEN CASE WHEN b IN ({_IN(rules.LEAVING_STATUSES)}) THEN b ELSE a END WHEN ({_RANK_SQL('b')}) >= ({_RANK_SQL('a')}) THEN b ELSE a END) AS final_status
FROM (SELECT *, [{_IN(_EV_STATUS)}][event_id * 7 % 11 % 7 + 1] AS status FROM events) GROUP BY user_id""")
def status_fold(spark, sf_dir):
    """An ordered fold of each user's observations."""
    s = F.get(F.array(*map(F.lit, _EV_STATUS)), (F.col("event_id") * 7 % 11 % 7).cast("int"))
    return merge.status_fold(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", s.alias("status")), "user_id", ["ts", "event_id"], "status")


@query("WITH e AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT user_id, event_id, ['DETECTADA', 'CONVOCADA', 'PLAZO_ABIERTO', 'ADMITIDOS_PROVISIONAL', 'SUSPENDIDA', 'REABIERTA', 'NOTAS'] AS l, before FROM e WHERE before IS NOT NULL), x AS (SELECT event_id, l[event_id * 7 % 11 % 7 + 1] AS new, l[before * 7 % 11 % 7 + 1] AS old, [1, 2, 3, 5, 0, 0, 9][event_id * 7 % 11 % 7 + 1] AS rn, [1, 2, 3, 5, 0, 0, 9][before * 7 % 11 % 7 + 1] AS ro FROM s) SELECT event_id, CASE WHEN new IN ('SUSPENDIDA', 'REABIERTA') THEN new WHEN old IN ('SUSPENDIDA', 'REABIERTA') THEN CASE WHEN new = 'PLAZO_ABIERTO' THEN new ELSE old END WHEN rn >= ro THEN new ELSE old END AS status FROM x")
def merge_step(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before")).where("before is not null")
    s = lambda c: F.get(F.array(*map(F.lit, _EV_STATUS)), (F.col(c) * 7 % 11 % 7).cast("int"))
    return e.select("event_id", merge.prefer_status(s("before"), s("event_id")).alias("status"))


# --- documents and pages ---------------------------------------------------------


_FOLDERS = "SELECT page_id, CAST(page_id % 40 AS VARCHAR) AS folder_id, page_id % 40 % 5 <> 4 AS fits, CAST(DATE '2026-01-01' + CAST(page_id % 7 AS INTEGER) AS DATE) AS published, 'https://www.martos.es/download/' || CAST(page_id % 40 AS VARCHAR) || CASE WHEN page_id % 40 % 5 = 4 THEN '/otro-asunto/' ELSE '/CONVOCATORIA-2-plazas-Inform%C3%A1tica-informatica-' || CAST(page_id % 3 AS VARCHAR) || '/' END || CAST(page_id AS VARCHAR) || '.pdf' AS url FROM pages"


@query(f"""SELECT folder_id, arg_max('Convocatoria 2 plazas informática informatica ' || CAST(page_id % 3 AS VARCHAR), (published, page_id)) AS title, count(*) AS documents, arg_max(page_id, (published, page_id)) AS newest,
  md5(string_agg('d' || CAST(page_id AS VARCHAR), chr(10) ORDER BY published DESC, page_id DESC)) AS text_md5, count(DISTINCT page_id % 11) AS links
FROM ({_FOLDERS}) WHERE fits GROUP BY folder_id""")
def folder_group(spark, sf_dir):
    p = spark.sql(_FOLDERS.replace("VARCHAR", "STRING").replace("DATE '2026-01-01' + CAST(page_id % 7 AS INTEGER)", "date_add(DATE '2026-01-01', CAST(page_id % 7 AS INTEGER))").replace("FROM pages", "FROM {pages}"), pages=read(spark, sf_dir, "pages").select("page_id"))
    docs = p.select(F.col("page_id").alias("id"), "published", text.folder_of(F.col("url")).alias("folder"), F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("text"), F.array(F.col("page_id") % 11).alias("links"))
    return views.folder_groups(docs).select("folder_id", "title", "documents", "newest", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("links").cast("long").alias("links"))


@query("WITH d AS (SELECT c_custkey AS id, c_custkey % 100 AS folder_id, c_nationkey AS first_seen FROM customer), o AS (SELECT folder_id, arg_min(id, (first_seen, id)) AS oldest FROM d GROUP BY folder_id), w AS (SELECT folder_id, CASE WHEN folder_id % 3 = 0 THEN folder_id + 100 ELSE oldest END AS process_id FROM o) SELECT id AS alias_id, process_id FROM d JOIN w USING (folder_id) WHERE id <> process_id")
def folder_aliases(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).alias("folder_id"), F.col("c_nationkey").alias("first_seen"))
    owners = spark.range(100).where("id % 3 = 0").select(F.col("id").alias("folder_id"), (F.col("id") + 100).alias("id"))
    return views.folder_aliases(d, owners)


@query()
def html_text(spark, sf_dir):
    """Visible text and links of pages; a parser, which SQL can't express. Tests hold it against cases."""
    return html.read_pages(read(spark, sf_dir, "pages")).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("links").alias("n_links"), "near_empty")


@query()
def html_links(spark, sf_dir):
    return html.links(html.read_pages(read(spark, sf_dir, "pages")))


_SPLIT = "l AS (SELECT doc_id, i AS pos, trim(s) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), h AS (SELECT doc_id, pos, line, length(line) < 40 AS head, max(pos) OVER (PARTITION BY doc_id) AS last FROM l)"


@query(f"WITH {_SPLIT} SELECT doc_id, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), last + 1) AS stop, md5(line) AS heading FROM h WHERE head")
def split_documents(spark, sf_dir):
    lines = splitter.lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    heads = lines.where(F.length("line") < 40)
    out = views.body_end(heads, ["doc_id"], "pos", F.col("last") + 1)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("stop").cast("long").alias("stop"), F.md5(F.col("line").cast("binary")).alias("heading"))


# --- collection and dispatch -----------------------------------------------------


@query(f"""WITH {OBS}, {NORM}, {QUALIFIED}, x AS (SELECT base.seq, source, {RELEVANT_SQL} AS relevant, {AREA_SQL} AS area, {ACCESS_SQL} AS access, compatibility AS evidence FROM base JOIN judged USING (seq)),
y AS (SELECT *, relevant AND area AND access <> 'PROMOCION_INTERNA_EXCLUSIVA' AND evidence <> 'NO_COMPATIBLE' AS ok, CASE WHEN access = 'PROMOCION_INTERNA_EXCLUSIVA' THEN 'NO_COMPATIBLE' ELSE evidence END AS compatibility, seq % 5 = 0 AS tracked FROM x),
z AS (SELECT *, ok AND seq % 7 <> 0 AS strict, ok AS included FROM y)
SELECT source, count(*) AS fetched, count(*) FILTER (included OR tracked) AS included, count(*) FILTER (tracked) AS tracked_kept, count(*) FILTER (NOT (included OR tracked)) AS filtered,
  count(*) FILTER (strict AND compatibility = 'COMPATIBLE') AS compatible, count(*) FILTER (included AND NOT (strict AND compatibility = 'COMPATIBLE')) AS review, count(*) FILTER (tracked AND NOT included) AS not_compatible FROM z GROUP BY source""")
def collect_counters(spark, sf_dir):
    e = classify.evaluate(_observed(spark, sf_dir), PROFILE)
    k = F.col("seq")
    # Every seventh row fails a gate that review lets pass, so that some rows are rescued.
    e = e.withColumn("decision", F.col("decision").withField("include", F.col("decision.include") & (k % 7 != 0)))
    e = e.withColumns({"tracked": k % 5 == 0, "enrollable": k % 3 == 0, "may_be_open": k % 3 == 1, "first_notify": F.lit(True)})
    return collect.counters(collect.decide(e, only_enrollable_new=False, show_review=True, first_run=False), "source")


@query("SELECT o_orderkey, CASE WHEN NOT (a OR b) OR (kind IN ('UPDATE', 'REMINDER') AND NOT f) OR (kind IN ('NEW', 'REVIEW', 'REMINDER') AND NOT o AND NOT (kind = 'REVIEW' AND m)) THEN 'SUPPRESS' WHEN kind = 'NEW' AND NOT a AND b THEN 'SEND_AS_REVIEW' ELSE 'SEND' END AS action FROM (SELECT o_orderkey, ['NEW', 'REVIEW', 'UPDATE', 'REMINDER'][o_orderkey % 4 + 1] AS kind, o_orderkey % 3 = 0 AS a, o_custkey % 2 = 0 AS b, o_custkey % 5 = 0 AS f, o_orderkey % 7 < 5 AS o, o_custkey % 3 = 0 AS m FROM orders)")
def dispatch_decision(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(*map(F.lit, ("NEW", "REVIEW", "UPDATE", "REMINDER"))), (k % 4).cast("int"))
    action = outbox.dispatch_decision(kind, k % 3 == 0, c % 2 == 0, c % 5 == 0, k % 7 < 5, c % 3 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"))


@query("SELECT o_orderkey, CASE WHEN ch AND p IN ('NEW', 'REVIEW') AND i THEN 'REWRITE' WHEN ch AND p IN ('NEW', 'REVIEW') THEN 'SUPPRESS' WHEN ch AND p = 'UPDATE' THEN 'EXTEND' WHEN ch AND n AND (i OR s) THEN 'INSERT_UPDATE' WHEN NOT ch AND w AND m AND n AND p IS NOT NULL THEN 'EXTEND' WHEN NOT ch AND w AND m AND n THEN 'INSERT_UPDATE' ELSE 'TOUCH' END AS action FROM (SELECT o_orderkey, ['NEW', 'REVIEW', 'UPDATE', NULL][o_orderkey % 4 + 1] AS p, o_orderkey % 3 = 0 AS i, o_custkey % 2 = 0 AS ch, o_custkey % 5 <> 0 AS n, o_orderkey % 7 < 2 AS s, o_custkey % 3 = 0 AS w, o_orderkey % 5 < 3 AS m FROM orders)")
def event_compaction(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pending = F.get(F.array(F.lit("NEW"), F.lit("REVIEW"), F.lit("UPDATE"), F.lit(None).cast("string")), (k % 4).cast("int"))
    action = merge.event_action(pending, k % 3 == 0, c % 2 == 0, c % 5 != 0, k % 7 < 2, c % 3 == 0, k % 5 < 3)
    return read(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"))


@query("SELECT 'repeated_keys' AS check, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'orphans_l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def integrity_check(spark, sf_dir):
    return upsert.integrity(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_orderkey": (read(spark, sf_dir, "orders"), "o_orderkey")})


_ESCAPED = "list_transform(string_split(t, ''), lambda c: CASE c WHEN '&' THEN '&amp;' WHEN '<' THEN '&lt;' WHEN '>' THEN '&gt;' WHEN '\"' THEN '&quot;' WHEN '''' THEN '&#x27;' ELSE c END)"
_MARKED = "substr('<&>\"''', 1 + CAST(c_custkey % 5 AS INTEGER), 1) || CAST(c_custkey AS VARCHAR) || '<b>&amp;\"x''' || c_name || repeat('n', CAST(c_custkey % 3 AS INTEGER))"


@query(f"""SELECT c_custkey, CASE WHEN length(array_to_string(e, '')) <= 24 THEN array_to_string(e, '') ELSE array_to_string(list_filter(e, lambda c, i: length(array_to_string(e[1:i], '')) <= 23), '') || '…' END AS short
FROM (SELECT c_custkey, {_ESCAPED} AS e FROM (SELECT c_custkey, {_MARKED} AS t FROM customer))""")
def budgeted_text(spark, sf_dir):
    marked = F.concat(F.substring(F.lit("<&>\"'"), F.lit(1) + (F.col("c_custkey") % 5).cast("int"), F.lit(1)), F.col("c_custkey").cast("string"), F.lit("<b>&amp;\"x'"), F.col("c_name"), F.repeat(F.lit("n"), (F.col("c_custkey") % 3).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", text.escape_limited(marked, 24).alias("short"))
