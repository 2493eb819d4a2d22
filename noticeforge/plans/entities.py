"""Queries over entities, links, runs and deliveries, with equivalent SQL. They join the registry's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import classify, extract, identity, rules, text
from noticeforge.operators import merge, outbox, resolve, scratch, settle, views
from noticeforge.plans.registry import TODAY, TODAY_SQL, dealt, n_, query, read
from noticeforge.sources import bulletin

_DAY = "CAST(o_orderdate AS DATE)"


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumns({"k": F.col("o_orderkey"), "day": F.col("o_orderdate").cast("date")})


@query(f"""SELECT o_orderkey, CASE WHEN k % 2 = 0 AND deadline >= {TODAY_SQL} THEN true WHEN exam >= {TODAY_SQL} THEN true WHEN deadline < {TODAY_SQL} THEN false WHEN published IS NOT NULL THEN date_diff('day', published, {TODAY_SQL}) <= 30 ELSE k % 3 = 0 END AS notify
FROM (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 THEN {_DAY} END AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN {_DAY} END AS exam, CASE WHEN o_orderkey % 7 > 1 THEN {_DAY} END AS published FROM orders)""")
def first_run_notify(spark, sf_dir):
    o, k, day = _orders(spark, sf_dir), F.col("k"), F.col("day")
    special = F.when(k % 3 == 0, "TAI_ESTADO").otherwise("")
    rule = classify.notify_at_first(F.when(k % 4 < 2, day), k % 2 == 0, F.when(k % 5 == 0, day), F.when(k % 7 > 1, day), special, F.lit(TODAY), 30)
    return o.select("o_orderkey", rule.alias("notify"))


@query(f"SELECT o_orderkey, coalesce(o_custkey % 10 = 0, false) OR CASE WHEN o_orderkey % 6 = 0 THEN true ELSE date_diff('day', {_DAY}, {TODAY_SQL}) <= 400 AND date_diff('day', {_DAY}, {TODAY_SQL}) >= 0 END AS within FROM orders")
def age_window(spark, sf_dir):
    k = F.col("k")
    return _orders(spark, sf_dir).select("o_orderkey", classify.in_window(F.when(k % 6 != 0, F.col("day")), F.lit(TODAY), F.lit(400), F.col("o_custkey") % 10 == 0, undated=True, future=False).alias("within"))


_NOTICES = ("Corrección de errores", "Rectificación de las bases", "Modificación de las bases", "Se modifican las bases", "Ampliación de plazo", "Lista de admitidos")
_CASES = lambda key, values: f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _pick(key, values):
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN '{rules.NOTICE_CHANGES[0][1]}' WHEN o_orderkey % 6 < 5 THEN '{rules.NOTICE_CHANGES[1][1]}' END AS change FROM orders")
def material_notice(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", classify.material_notice(F.lit("Anuncio."), _pick(F.col("k"), _NOTICES)).alias("change"))


#: Tells the lines of an order apart and orders them.
_SEQ = "(l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey"


@query(f"SELECT process_id, url, label, CAST(row_number() OVER (PARTITION BY process_id ORDER BY first) AS INTEGER) AS place FROM (SELECT l_orderkey AS process_id, 'u' || CAST(l_suppkey % 3 AS VARCHAR) AS url, arg_max(l_returnflag, ({_SEQ})) AS label, min(({_SEQ})) AS first FROM lineitem GROUP BY ALL)")
def link_union(spark, sf_dir):
    return views.link_union(_links(spark, sf_dir, F.col("l_returnflag")))


def _links(spark, sf_dir, label) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.expr(_SEQ).alias("seq"), F.concat(F.lit("u"), (F.col("l_suppkey") % 3).cast("string")).alias("url"), label.alias("label"))


_MILESTONE = "CASE WHEN l_suppkey % 4 = 0 THEN 'Bases' ELSE 'Lista de ' || CAST(l_suppkey % 29 + 1 AS VARCHAR) || ' de mayo de ' || CAST(2020 + l_partkey % 3 AS VARCHAR) END"


@query(f"""WITH u AS (SELECT l_orderkey AS process_id, 'u' || CAST(l_suppkey % 3 AS VARCHAR) AS url, arg_max({_MILESTONE}, ({_SEQ})) AS label,
  arg_max(CASE WHEN l_suppkey % 4 <> 0 THEN 1 ELSE 0 END, ({_SEQ})) AS has, arg_max(strftime(make_date(2020 + l_partkey % 3, 5, l_suppkey % 29 + 1), '%Y-%m-%d'), ({_SEQ})) AS day, min(({_SEQ})) AS first FROM lineitem GROUP BY ALL)
SELECT process_id, arg_max(url, (day, -first)) AS url, arg_max(label, (day, -first)) AS label, max(day) AS day FROM u WHERE has = 1 GROUP BY process_id""")
def newest_milestone(spark, sf_dir):
    label = F.when(F.col("l_suppkey") % 4 == 0, "Bases").otherwise(F.concat(F.lit("Lista de "), (F.col("l_suppkey") % 29 + 1).cast("string"), F.lit(" de mayo de "), (2020 + F.col("l_partkey") % 3).cast("string")))
    return views.newest_milestone(views.link_union(_links(spark, sf_dir, label)), text.milestone_date(F.col("label")))


@query("SELECT c_custkey - c_custkey % 10 * (c_custkey % 30 < 20)::int AS id, array_to_string(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey % 10 > 0 AND c_custkey % 30 < 20), ',') AS aliases, max(c_nationkey) AS last_seen, max(c_acctbal) AS last_changed FROM customer GROUP BY 1")
def alias_groups(spark, sf_dir):
    k, c = F.col("c_custkey"), read(spark, sf_dir, "customer")
    p = c.select(k.alias("id"), F.col("c_nationkey").alias("last_seen"), F.col("c_acctbal").alias("last_changed"))
    a = c.where((k % 10 > 0) & (k % 30 < 20)).select(k.alias("alias_id"), (k - k % 10).alias("process_id"))
    # An id that only aliases point at has a group as well.
    return views.alias_groups(p, a).select("id", F.when(F.size("aliases") > 0, F.array_join("aliases", ",")).alias("aliases"), "last_seen", "last_changed")


@query("SELECT user_id AS source, max(event_id) AS newest, max(event_id) FILTER (event_id % 3 <> 0) AS completed, max(event_id) FILTER (event_type = 'click') AS succeeded, max(event_id) FILTER (event_id % 3 = 0) AS active FROM events GROUP BY user_id")
def run_states(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    return views.run_states(e.select(F.col("user_id").alias("source"), k.alias("id"), F.when(F.col("event_type") == "click", "OK").otherwise("ERROR").alias("status"), F.when(k % 3 != 0, F.col("ts")).alias("finished_at")))


@query(f"""SELECT o_orderkey, own AS covered_through, CASE WHEN warning <> '' OR coalesce(own < {TODAY_SQL}, true) THEN 'PARTIAL' ELSE 'OK' END AS status FROM (SELECT *, CASE WHEN failed IS NOT NULL THEN least(coalesce(base, {TODAY_SQL}), failed - 1) ELSE base END AS own
FROM (SELECT *, CASE WHEN covered IS NOT NULL THEN least(covered, {TODAY_SQL}) WHEN warning = '' THEN {TODAY_SQL} END AS base FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} END AS covered, CASE WHEN o_orderkey % 4 = 0 THEN 'w' ELSE '' END AS warning, CASE WHEN o_orderkey % 5 = 0 THEN {_DAY} - 9 END AS failed FROM orders)))""")
def source_coverage(spark, sf_dir):
    k, day = F.col("k"), F.col("day")
    x = views.coverage(F.when(k % 3 == 0, day), F.when(k % 4 == 0, "w").otherwise(""), F.when(k % 5 == 0, F.date_sub(day, 9)), F.lit(TODAY))
    return _orders(spark, sf_dir).select("o_orderkey", x.alias("x")).select("o_orderkey", "x.*")


_OLD = {"title": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a' END", "organisation": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'o' END", "locality": "'l'", "positions": "CAST(o_orderkey % 9 AS INTEGER)", "deadline": _DAY, "confirmed": "o_orderkey % 2 = 0", "access": "'LIBRE'", "compatibility": "CASE o_orderkey % 3 WHEN 0 THEN 'REVISAR' WHEN 1 THEN 'COMPATIBLE' ELSE 'NO_COMPATIBLE' END", "priority": "CAST(o_orderkey % 4 AS INTEGER)"}
_NEW = {"title": "'b'", "organisation": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'p' END", "locality": "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'm' END", "positions": "CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 8 AS INTEGER) END", "deadline": f"CASE WHEN o_custkey % 4 > 0 THEN {_DAY} + 7 END", "confirmed": "o_custkey % 3 = 0", "access": "CASE WHEN o_custkey % 2 = 0 THEN 'REVISAR' ELSE 'MIXTO' END", "compatibility": "CASE WHEN o_custkey % 2 = 0 THEN 'REVISAR' ELSE 'COMPATIBLE' END", "priority": "CAST(o_custkey % 5 AS INTEGER)"}
_SIDES = "SELECT o_orderkey, o_custkey % 7 = 0 AS structured, " + ", ".join(f"{v} AS old_{c}" for c, v in _OLD.items()) + ", " + ", ".join(f"{v} AS new_{c}" for c, v in _NEW.items()) + " FROM orders"


@query(f"""SELECT o_orderkey, coalesce(nullif(old_title, ''), new_title, old_title) AS title, CASE WHEN structured THEN new_organisation ELSE coalesce(nullif(old_organisation, ''), new_organisation, old_organisation) END AS organisation,
  coalesce(nullif(new_locality, ''), old_locality, new_locality) AS locality, CASE WHEN structured THEN new_positions ELSE coalesce(new_positions, old_positions) END AS positions,
  CASE WHEN structured OR new_deadline IS NOT NULL THEN new_deadline ELSE old_deadline END AS deadline, CASE WHEN structured OR new_deadline IS NOT NULL THEN new_confirmed ELSE old_confirmed END AS deadline_confirmed,
  CASE WHEN new_access = 'REVISAR' THEN old_access ELSE new_access END AS access, CASE WHEN new_compatibility = 'REVISAR' AND old_compatibility <> 'REVISAR' THEN old_compatibility ELSE new_compatibility END AS compatibility, greatest(old_priority, new_priority) AS priority FROM ({_SIDES})""")
def merged_entities(spark, sf_dir):
    o = spark.sql(_SIDES.replace("VARCHAR", "STRING").replace(f"{_DAY} + 7", f"date_add({_DAY}, 7)").replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))
    absent = [c for c in (*merge.OLD_WINS, *merge.NEW_TEXT_WINS, *merge.NEW_VALUE_WINS, "status") if c not in _OLD]
    def side(name):
        return F.struct(*(F.col(f"{name}_{c}").alias("deadline_confirmed" if c == "confirmed" else c) for c in _OLD), *(F.lit(None).cast("string").alias(c) for c in absent), (F.col("structured") if name == "new" else F.lit(False)).alias("structured"))

    both = o.select("o_orderkey", side("old").alias("old"), side("new").alias("new"))
    out = merge.merged()
    return both.select("o_orderkey", *(out[c].alias(c) for c in ("title", "organisation", "locality", "positions", "deadline", "deadline_confirmed", "access", "compatibility", "priority")))


_STEP = lambda a, b: f"CASE WHEN {a} IS DISTINCT FROM {b} THEN '{{}}:' || coalesce(CAST({a} AS VARCHAR), '-') || '>' || coalesce(CAST({b} AS VARCHAR), '-') END"


@query(f"SELECT o_orderkey, concat_ws(';', {_STEP('p0', 'p2').format('positions')}, {_STEP('s0', 's2').format('status')}) AS details FROM (SELECT o_orderkey, o_orderkey % 3 AS p0, o_orderkey % 2 AS p1, o_custkey % 3 AS p2, o_orderstatus AS s0, 'F' AS s1, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS s2 FROM orders)")
def change_details(spark, sf_dir):
    """Details of two changes in a row, merged: each field's first old and last new value, without those that came back."""
    o = _orders(spark, sf_dir).withColumns({"p0": F.col("k") % 3, "p1": F.col("k") % 2, "p2": F.col("o_custkey") % 3, "s0": F.col("o_orderstatus"), "s1": F.lit("F"), "s2": F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")})
    at = lambda i: {"positions": F.col(f"p{i}"), "status": F.col(f"s{i}")}
    step = lambda i: identity.change_details(at(i), at(i + 1), F.lit("u"), F.lit("r"), F.lit("t"))
    both = F.array_sort(identity.merge_details(step(0), step(1)))
    shown = F.transform(both, lambda d: F.concat(d["field"], F.lit(":"), F.coalesce(d["old"], F.lit("-")), F.lit(">"), F.coalesce(d["new"], F.lit("-"))))
    return o.select("o_orderkey", F.array_join(shown, ";").alias("details"))


_KEY = "CASE o_orderkey % 4 WHEN 0 THEN 'new:' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'new:' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'update:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) ELSE 'reminder:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) END"


@query(f"""SELECT o_orderkey, key, substr(sha256('"' || key || '"'), 1, 32) AS id FROM (SELECT o_orderkey, {_KEY} AS key FROM orders)""")
def event_keys(spark, sf_dir):
    kind = _pick(F.col("k"), ("NEW", "REVIEW", "UPDATE", "REMINDER"))
    o = _orders(spark, sf_dir).select("o_orderkey", merge.event_key(kind, F.col("o_custkey").cast("string"), F.col("k").cast("string")).alias("key"))
    return o.withColumn("id", merge.event_id(F.col("key")))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 3 AND event_id % 3 = 0 THEN ['SENT', 'UNCERTAIN'][event_id % 2 + 1] WHEN event_id % 5 = 3 THEN 'SENT' WHEN event_id % 7 = 0 THEN 'SUPPRESSED' ELSE ['PENDING', 'RETRYABLE', 'SENDING', 'SENT', 'SUPPRESSED'][event_id % 5 + 1] END AS status, CASE WHEN event_id % 5 <> 3 AND event_id % 3 = 0 THEN 'm' END AS message_id FROM events")
def delivery_marks(spark, sf_dir):
    """Outcomes of deliveries, then suppression of some: what was sent stays sent."""
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id", _pick(k, ("PENDING", "RETRYABLE", "SENDING", "SENT", "SUPPRESSED")).alias("status"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("message_id"))
    results = read(spark, sf_dir, "events").where(k % 3 == 0).select("event_id", _pick(k, ("SENT", "UNCERTAIN")).alias("new_status"), F.col("ts").alias("sent_at"), F.lit("m").alias("message_id"))
    marked = outbox.mark(e, results)
    return outbox.suppress(marked, (k % 7 == 0) & (k % 3 != 0)).select("event_id", "status", "message_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' ELSE url END AS safe FROM (SELECT page_id, 'http' || CASE WHEN page_id % 2 = 0 THEN 's' ELSE '' END || '://e.org/' || CAST(page_id AS VARCHAR) AS url FROM pages)")
def safe_links(spark, sf_dir):
    k = F.col("page_id")
    own = F.concat(F.lit("http"), F.when(k % 2 == 0, "s").otherwise(""), F.lit("://e.org/"), k.cast("string"))
    url = F.when(k % 3 == 2, F.concat(F.lit("javascript:"), own)).otherwise(own)
    return read(spark, sf_dir, "pages").select("page_id", text.safe_url(url).alias("safe"))


@query("""WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 's' || CAST(l_linenumber % 3 AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS external_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 4 AS INTEGER) END AS positions, 'k' || CAST(l_orderkey // 8 AS VARCHAR) AS canonical_key FROM lineitem),
p AS (SELECT o_orderkey AS process_id, 'k' || CAST(o_orderkey // 8 AS VARCHAR) AS canonical_key, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 4 AS INTEGER) END AS old_positions, o_orderdate AS first_seen FROM orders),
i AS (SELECT 's' || CAST(o_custkey % 3 AS VARCHAR) AS source, CAST(o_custkey AS VARCHAR) AS external_id, o_orderkey AS process_id FROM orders WHERE o_orderkey % 4 = 0)
SELECT seq, arg_min(process_id, (first_seen, process_id)) AS process_id FROM n JOIN p USING (canonical_key) WHERE (positions IS NULL OR old_positions IS NULL OR positions = old_positions)
  AND NOT EXISTS (SELECT 1 FROM i WHERE i.process_id = p.process_id AND i.source = n.source AND i.external_id <> n.external_id) GROUP BY seq""")
def key_resolution(spark, sf_dir):
    k = F.col("l_linenumber")
    new = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("seq"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.col("l_partkey").cast("string").alias("external_id"), F.when(k % 2 == 0, (F.col("l_suppkey") % 4).cast("int")).alias("positions"), F.concat(F.lit("k"), F.expr("l_orderkey div 8").cast("string")).alias("canonical_key"))
    o, key, customer = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    old = o.select(key.alias("id"), F.concat(F.lit("k"), F.expr("o_orderkey div 8").cast("string")).alias("canonical_key"), F.when(key % 3 > 0, (customer % 4).cast("int")).alias("positions"), F.col("o_orderdate").alias("first_seen"))
    items = o.where(key % 4 == 0).select(F.concat(F.lit("s"), (customer % 3).cast("string")).alias("source"), customer.cast("string").alias("external_id"), key.alias("process_id"))
    return resolve.by_key(new, old, items)


# --- records, followed items, orders -------------------------------------------------


@query("SELECT DISTINCT 's' || CAST(o_custkey % 3 AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS external_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def followed_items(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_custkey")
    items = o.select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), k.alias("process_id"))
    return views.followed_items(items, read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("process_id")))


@query(f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN {_DAY} END DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders")
def newest_first(spark, sf_dir):
    return views.newest_first(_orders(spark, sf_dir), ["o_custkey"], F.when(F.col("k") % 5 > 0, F.col("day")), F.col("k")).select("o_orderkey", "place")


@query(f"""WITH u AS (SELECT l_orderkey AS id, list(struct_pack(f := {_SEQ}, s := 's' || CAST(l_suppkey % 3 AS VARCHAR), u := 'u' || CAST(l_partkey AS VARCHAR)) ORDER BY {_SEQ}, l_suppkey % 3) AS x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
SELECT o_orderkey AS external_id, coalesce(x[1].s, 'database') AS source, coalesce(array_to_string(list_transform(x, lambda l: l.s || '>' || l.u), ' '), '') AS links, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS exam_date_provisional FROM orders LEFT JOIN u ON id = o_orderkey""")
def entity_records(spark, sf_dir):
    """Orders as entities, with lines as their addresses: back to notices with links in order and the provisional mark."""
    k = F.col("o_orderkey")
    p = read(spark, sf_dir, "orders").select(k.alias("id"), F.lit("x").alias("source"), F.when(k % 3 == 0, '{"exam_date_provisional":true}').when(k % 3 == 1, '{"exam_date_provisional":false}').otherwise("{}").alias("snapshot"), F.lit("").alias("semantic_hash"))
    u = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("process_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.lit("").alias("label"), F.expr(_SEQ).alias("first_seen"))
    out = views.records(p, u)
    return out.select("external_id", "source", F.array_join(F.transform("links", lambda x: F.concat(x["source"], F.lit(">"), x["url"])), " ").alias("links"), "exam_date_provisional")


_TERMS = ("th", "an", "on", "re", "ch")


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f"{chr(39)}{t}{chr(39)}" for t in _TERMS)}], lambda t: contains({n_('text')}, t))[1:3], ', ') AS terms FROM documents")
def evidence_terms(spark, sf_dir):
    n = dealt(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.normalize(F.col("text")).alias("n"))
    return n.select("doc_id", classify.evidence_terms(text.hits(F.col("n"), _TERMS)).alias("terms"))


# --- identity within a run -----------------------------------------------------------

_K = "CAST(l_orderkey AS VARCHAR)"
_NOTICE = f"""SELECT l_orderkey AS org, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) AS n, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) AS seq, 's' || CAST(l_suppkey % 2 AS VARCHAR) AS source, {_K} || '-' || CAST(l_partkey % 4 AS VARCHAR) AS external_id,
  CASE WHEN l_suppkey % 4 = 0 THEN {_K} || 'r' || CAST(l_suppkey % 3 AS VARCHAR) END AS reference, CASE WHEN l_linenumber % 2 = 0 THEN {_K} || 'r' || CAST(l_partkey % 3 AS VARCHAR) END AS citation,
  CASE l_returnflag WHEN 'A' THEN 'tecnico auxiliar' WHEN 'N' THEN CASE WHEN l_partkey % 2 = 0 THEN 'tecnico auxiliar informatica' ELSE 'conserje' END ELSE 'conserje' END AS signature,
  CASE l_linenumber % 3 WHEN 0 THEN 'REVISAR' WHEN 1 THEN 'LIBRE' ELSE CASE WHEN l_suppkey % 5 = 0 THEN 'MIXTO' ELSE 'LIBRE' END END AS access, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey % 2 AS INTEGER) END AS positions FROM lineitem"""
_ITEM = "source || ':' || external_id"
_APART = f"(len(list_filter(e.items, lambda i: i <> it AND string_split(i, ':')[1] = source)) > 0 OR coalesce(positions <> e.positions, false))"
_FITS = "(access = 'REVISAR' OR e.access = 'REVISAR' OR access = e.access) AND (signature = 'conserje') = (e.signature = 'conserje')"
_OLDEST, _LATEST = ("list_filter({}, lambda e: {})[1].id".format, "list_sort(list_transform(list_filter({}, lambda e: {}), lambda e: {{'last': e.last, 'id': e.id}}), 'DESC')[1].id".format)


@query(f"""WITH RECURSIVE n AS (SELECT *, {_ITEM} AS it, signature || access AS key FROM ({_NOTICE})),
runs AS (SELECT org, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS hit, NULL::VARCHAR AS stage, []::STRUCT(id BIGINT, last BIGINT, items VARCHAR[], refs VARCHAR[], key VARCHAR, signature VARCHAR, access VARCHAR, positions INTEGER)[] AS es FROM n GROUP BY org
  UNION ALL SELECT org, n, seq, hit, stage, CASE WHEN stage = 'new' THEN list_append(es, {{'id': seq, 'last': n, 'items': own, 'refs': refs, 'key': key, 'signature': signature, 'access': access, 'positions': positions}})
    ELSE list_transform(es, lambda e: CASE WHEN e.id = hit THEN {{'id': e.id, 'last': n, 'items': list_concat(e.items, own), 'refs': list_concat(e.refs, refs), 'key': e.key, 'signature': e.signature, 'access': CASE WHEN access = 'REVISAR' THEN e.access ELSE access END, 'positions': coalesce(positions, e.positions)}} ELSE e END) END AS es
  FROM (SELECT *, coalesce(by_item, by_reference, by_citation, by_key, by_title, seq) AS hit, CASE WHEN by_item IS NOT NULL THEN 'item' WHEN by_reference IS NOT NULL THEN 'reference' WHEN by_citation IS NOT NULL THEN 'citation' WHEN by_key IS NOT NULL THEN 'key' WHEN by_title IS NOT NULL THEN 'title' ELSE 'new' END AS stage,
      CASE WHEN by_item IS NULL THEN [it] ELSE [] END AS own, CASE WHEN reference IS NULL OR by_reference IS NOT NULL THEN [] ELSE [reference] END AS refs
    FROM (SELECT runs.es, n.*, {_OLDEST('es', 'list_contains(e.items, it)')} AS by_item, {_OLDEST('es', 'list_contains(e.refs, reference)')} AS by_reference, {_OLDEST('es', 'list_contains(e.refs, citation) AND ' + _FITS)} AS by_citation,
        list_filter(list_filter(es, lambda e: e.key = n.key)[1:1], lambda e: NOT {_APART})[1].id AS by_key, {_LATEST('es', _FITS + ' AND NOT ' + _APART)} AS by_title
      FROM runs JOIN n ON n.org = runs.org AND n.n = runs.n + 1)))
SELECT seq, hit AS first_seq, stage FROM runs WHERE n > 0""")
def batch_identity(spark, sf_dir):
    """The lines of an order as notices of one issuer, settled in order within the run: what finds an entity, and which."""
    rows = spark.sql(_NOTICE.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    org = F.col("org").cast("string")
    notices = rows.select("seq", "source", "external_id", listed("reference").alias("references"), listed("citation").alias("cited"), F.concat_ws("|", org, "signature", "access").alias("canonical_key"), org.alias("organisation"), "signature", F.lit("").alias("group"), "access", "positions", *(F.lit("").alias(c) for c in ("published", "titled")), *(F.lit(True).alias(c) for c in ("keep_new", "keep_tracked")))
    notices = scratch.cut(notices, "notices")
    # limit(0) lets the optimizer leave out what joins with them.
    empty = lambda schema: spark.createDataFrame([], schema).limit(0)
    processes = empty("id string, first_seen timestamp, last_seen timestamp, canonical_key string, organisation string, signature string, `group` string, access string, positions int, published string, titled string")
    known = settle.known(notices, processes, empty("source string, external_id string, process_id string"), empty("reference string, process_id string"), empty("alias_id string, process_id string"))
    # Notices come in order, so the one that makes an entity is its first.
    return settle.settle(notices, known, scratch.cut, "run").select("seq", F.col("made").alias("first_seq"), "stage")


# --- bulletins ---------------------------------------------------------------------

#: Ten documents make a bulletin: contents with wrapped titles, then bodies; of every seventh one the last body is missing, every eleventh has none at all.
_BULLETIN = """SELECT doc_id, bulletin, row_number() OVER (PARTITION BY bulletin ORDER BY doc_id) AS part, count(*) OVER (PARTITION BY bulletin) AS parts, 'plaza ' || doc_id || ' ' || source AS title, text FROM (SELECT doc_id, doc_id // 10 AS bulletin, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)"""
_LINES = r"list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda s: " + n_("s") + ")"


@query(f"""WITH b AS ({_BULLETIN}), f AS (SELECT *, CASE WHEN bulletin % 11 = 5 THEN 'no edict begins' WHEN bulletin % 7 = 3 THEN 'BOP-2026-' || max(doc_id) OVER (PARTITION BY bulletin) || ' has no body' END AS error FROM b)
SELECT bulletin, CAST(part AS INTEGER) AS part, 'BOP-2026-' || doc_id AS reference, 'Bases de una ' || title AS title, 'AYUNTAMIENTO DE LA VILLA' || CASE WHEN part % 2 = 0 THEN ' - Recursos Humanos' ELSE '' END AS organisation,
  md5(trim('2026 ' || doc_id || ' texto de las bases que rigen la convocatoria ' || array_to_string(list_filter({_LINES}, lambda s: s <> ''), ' '))) AS body, CAST(NULL AS VARCHAR) AS error FROM f WHERE error IS NULL
UNION ALL SELECT DISTINCT bulletin, NULL, NULL, NULL, NULL, NULL, error FROM f WHERE error IS NOT NULL""")
def bulletin_edicts(spark, sf_dir):
    """Bulletins made of documents, split into edicts: the contents' headings, and bodies in the order of the contents."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.expr("doc_id div 10").alias("bulletin"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    k, own = F.col("doc_id").cast("string"), Window.partitionBy("bulletin").orderBy("doc_id")
    d = d.withColumns({"part": F.row_number().over(own), "last": F.lead("doc_id").over(own).isNull()})
    entry = F.concat(F.lit("ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE LA VILLA\n"), F.when(F.col("part") % 2 == 0, "Recursos Humanos\n").otherwise(""), F.lit("Bases de una\nPág. 7\nplaza "), k, F.lit(" "), "source", F.lit("\nBOP-2026-"), k)
    none = (F.col("bulletin") % 11 == 5) | ((F.col("bulletin") % 7 == 3) & F.col("last"))
    body = F.when(~none, F.concat(F.lit("2026/"), k, F.lit("\nNúmero 200\nTexto de las bases que rigen la convocatoria\n"), "text"))
    rows = d.groupBy("bulletin").agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry"), body.alias("body")))).alias("rows"))
    whole = F.concat(F.transform("rows", lambda r: r["entry"]), F.filter(F.transform("rows", lambda r: r["body"]), lambda b: b.isNotNull()))
    out = bulletin.read(rows.select("bulletin", F.array_join(whole, "\n").alias("text")), "bulletin", "text")
    return out.withColumn("body", F.when(F.col("body").isNotNull(), F.md5(text.normalize(F.col("body")).cast("binary"))))


# --- dates in varied sentences -------------------------------------------------------

_DAYS = ("10", "quince", "veinte", "45")
_PAPERS = ("Boletín Oficial del Estado", "BOJA", "Boletín Oficial de la Provincia", "tablón")


@query(f"""WITH k AS (SELECT o_orderkey, o_orderkey % 5 AS a, (o_orderkey // 5) % 4 AS b, o_custkey % 4 AS c, {_DAY} AS day FROM orders)
SELECT o_orderkey, CASE WHEN a < 3 THEN day END AS deadline, a < 3 AS confirmed, CASE WHEN a = 3 THEN [10, 15, 20, 45][c + 1] END AS days, CASE WHEN a = 3 THEN CASE WHEN c % 2 = 0 THEN 'habiles' ELSE 'naturales' END END AS kind,
  CASE WHEN a = 3 THEN ['BOE', 'BOJA', 'BOP', ''][c + 1] END AS starts_after, CASE WHEN b <> 2 THEN day + 30 END AS exam_date, CASE b WHEN 0 THEN '0' || (c + 8 - 2 * (c // 2)) || ':05' WHEN 1 THEN '17:30' END AS exam_time,
  CASE b WHEN 0 THEN 'Palacio ' || c WHEN 1 THEN 'aula B-' || c ELSE '' END AS exam_place, b = 1 AS provisional FROM k""")
def varied_dates(spark, sf_dir):
    """Deadlines, periods and examinations of sentences whose wording, order and dates follow from the keys; some have none."""
    k, a = F.col("k"), F.col("k") % 5
    o, b, c = dealt(_orders(spark, sf_dir)), F.expr("(o_orderkey div 5) % 4"), F.col("o_custkey") % 4
    day, short, exam = F.date_format("day", "dd/MM/yyyy"), F.date_format("day", "d-M-yyyy"), F.date_format(F.date_add("day", 30), "d/M/yyyy")
    said = (
        F.when(a == 0, F.concat(F.lit("Plazo de presentación abierto hasta el "), day, F.lit(". ")))
        .when(a == 1, F.concat(F.lit("Presentación de solicitudes del 1/2/1990 al "), day, F.lit(". ")))
        .when(a == 2, F.concat(F.lit("FIN DEL PLAZO: "), short, F.lit("\n")))
        .when(a == 3, F.concat(F.lit("El plazo será de "), _pick(c, _DAYS), F.when(c % 2 == 0, " días hábiles").otherwise(" DIAS NATURALES"), F.lit(" desde el siguiente al de su publicación en el "), _pick(c, _PAPERS), F.lit(". ")))
        .otherwise("Bases de la convocatoria. ")
    )
    hour = (c + 8 - 2 * F.floor(c / 2)).cast("string")
    tested = (
        F.when(b == 0, F.concat(F.lit("Fecha del examen: "), exam, F.lit(", a las "), hour, F.lit(":05. Sede: Palacio "), c.cast("string"), F.lit(".")))
        .when(b == 1, F.concat(F.lit("El ejercicio se celebrará el "), exam, F.lit(" (fecha prevista), hora 17.30, aula B-"), c.cast("string"), F.lit(".")))
        .when(b == 3, F.concat(F.lit("La prueba será el "), exam, F.lit(".")))
        .otherwise("Resolución de 01/01/2020. Otros trámites.")
    )
    # In a part of the rows the examination comes first.
    t = F.when(k % 7 == 0, F.concat(tested, F.lit("\n"), said)).otherwise(F.concat(said, tested))
    o = o.select("o_orderkey", t.alias("t"))
    t = F.col("t")
    o = o.withColumns({"d": extract.deadline(t), "r": extract.relative_deadline(t)})
    d, r = F.col("d"), F.col("r")
    own = {"deadline": d["date"], "confirmed": d["confirmed"], "days": r["days"], "kind": r["kind"], "starts_after": r["starts_after"], "exam_date": extract.exam_date(t), "exam_time": extract.exam_time(t), "exam_place": F.coalesce(extract.exam_place(t), F.lit("")), "provisional": extract.exam_is_provisional(t)}
    return o.select("o_orderkey", *(v.alias(n) for n, v in own.items()))
