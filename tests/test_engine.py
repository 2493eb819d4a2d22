"""Scenarios over the state, delivery, sources and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from noticeforge.engine import OBSERVATION, Engine, Retry
from noticeforge.functions import classify, render, rules
from noticeforge.operators import merge, upsert, views
from noticeforge.sources import feeds, html, paged, splitter
from noticeforge.state import Conflict, State
from noticeforge.streaming import ingest

NOW = dt.datetime(2026, 10, 20, 8, 0, 0)
TODAY = NOW.date()


def observed(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = {"seq": i, "source": "boe", "external_id": f"e{i}", "title": "Convocatoria de 3 plazas de Técnico Auxiliar de Informática", "organisation": "Ayuntamiento de Martos", "summary": "", "full_text": "Acceso libre. Plazo de presentación hasta el 30/10/2026. Requisito: bachiller.", "reference": "", "url": "https://e.org/x", "locality": "Martos", "province": "Jaén", "group": "C1", "publication_date": dt.date(2026, 10, 1)}
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, OBSERVATION)


def test_state_versions(spark, tmp_path):
    s = State(spark, tmp_path.as_uri())
    assert s.version() == 0 and s.read("reminders").count() == 0
    one = spark.createDataFrame([("a", "b")], "alias_id string, process_id string")
    assert s.commit({"process_aliases": one}, 0) == 1
    assert s.commit({"process_aliases": one.union(one)}, 1) == 2
    assert s.read("process_aliases").count() == 2 and s.read("process_aliases", 1).count() == 1
    with pytest.raises(Conflict):
        s.commit({"process_aliases": one}, 1)
    assert s.version() == 2


def test_collect_deliver_follow(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    report = e.run(observed(spark, [{}, {"title": "Conserje", "full_text": "nada", "external_id": "z"}]), TODAY, NOW)
    assert report["version"] == 1 and report["sources"]["boe"]["fetched"] == 2 and report["sources"]["boe"]["filtered"] == 1
    assert e.stats() == {"processes": 1, "outbox_pending": 1}
    e.run(observed(spark, [{}]), TODAY, NOW + dt.timedelta(hours=1))  # the same again: nothing new
    assert e.stats() == {"processes": 1, "outbox_pending": 1}
    ids = e.claim(5, NOW)
    assert len(ids) == 1 and e.claim(5, NOW) == []
    sent = []
    assert e.dispatch(ids, lambda m: sent.append(m) or "m1", NOW, 0)["SENT"] == 1 and "Técnico" in sent[0]
    assert e.dispatch(ids, lambda m: sent.append(m) or "m1", NOW, 0)["SENT"] == 0 and len(sent) == 1
    e.run(observed(spark, [{"full_text": "Acceso libre. Plazo de presentación hasta el 05/11/2026. Requisito: bachiller."}]), TODAY, NOW + dt.timedelta(hours=2))
    assert e.stats()["outbox_pending"] == 1  # a change after delivery is a new event
    (pid,) = [r.id for r in e.state.read("processes").collect()]
    assert e.follow(pid[:8], NOW) == pid and e.state.read("followed_processes").count() == 1
    shown = e.catalog(TODAY).collect()
    assert [(r.id, r.category, r.followed) for r in shown] == [(pid, "OPEN", True)] and len(shown[0].history) == 2
    e.follow(pid[:8], NOW, on=False)
    assert e.state.read("followed_processes").count() == 0
    assert all(r.n == 0 for r in e.check().collect())
    assert pid in e.export(TODAY) and "Ficha" in e.card(pid[:9], TODAY) and e.is_followed(pid) is False
    assert [(r.source, r.status) for r in e.source_status().collect()] == [("boe", "OK")]
    with pytest.raises(ValueError):
        e.follow("zz", NOW)


def test_reminders_are_made_once(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    e.run(observed(spark, [{}]), TODAY, NOW)
    for _ in range(2):
        e.remind(dt.date(2026, 10, 27), [7, 3], NOW)
    assert e.state.read("reminders").count() == 1 and e.state.read("notification_outbox").where("kind = 'REMINDER'").count() == 1


def test_delivery_outcomes(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    e.run(observed(spark, [{"external_id": f"k{i}", "title": f"Programador informático {w}. Convocatoria", "organisation": o} for i, (w, o) in enumerate([("alfa", "Ayuntamiento de Martos"), ("beta", "Universidad de Jaén"), ("gamma", "Diputación de Jaén")])]), TODAY, NOW)
    ids = e.claim(3, NOW)
    answers = iter([RuntimeError("cut"), Retry(9)])

    def send(_):
        raise next(answers)

    assert e.dispatch(ids, send, NOW, 0) == {"SENT": 0, "RETRYABLE": 1, "UNCERTAIN": 1, "SUPPRESSED": 0, "RELEASED": 1}
    assert len(e.claim(9, NOW)) == 2  # the uncertain one is never claimed again
    e.recover(NOW + dt.timedelta(hours=1))
    assert e.stats()["outbox_uncertain"] == 3
    before = e.state.version()
    e.run(observed(spark, [{}]), TODAY, NOW, dry_run=True)
    assert e.state.version() == before


def test_observations_of_a_run_take_effect_in_order(spark, tmp_path):
    """A suspension followed by a list in one batch stays suspended; what is excluded for good isn't announced."""
    e = Engine(spark, tmp_path.as_uri(), classify.Profile(allowed_groups=("B", "C1")))
    rows = [
        {"full_text": "Se acuerda la suspensión. Acceso libre. Requisito: bachiller."},
        {"full_text": "Lista provisional de admitidos. Acceso libre. Requisito: bachiller.", "external_id": "e0"},
        {"external_id": "u", "title": "Analista programador", "organisation": "Universidad de Jaén", "full_text": "Acceso libre. Se exige titulación universitaria de grado."},
        {"external_id": "i", "title": "Programador", "organisation": "Diputación de Jaén", "full_text": "Turno de promoción interna."},
        {"external_id": "g", "title": "Operador de sistemas informáticos. Convocatoria", "organisation": "Diputación de Jaén", "group": ""},
        {"external_id": "a", "title": "Técnico informático. Convocatoria", "organisation": "Diputación de Jaén", "group": "A2"},
    ]
    report = e.run(observed(spark, rows), TODAY, NOW)["sources"]["boe"]
    assert (report["fetched"], report["included"], report["created"], report["updated"], report["unchanged"], report["filtered"], report["review"]) == (6, 3, 2, 0, 1, 3, 1)
    got = {r.title: r.status for r in e.state.read("processes").collect()}
    assert got["Convocatoria de 3 plazas de Técnico Auxiliar de Informática"] == "SUSPENDIDA" and len(got) == 2
    assert sorted(r.kind for r in e.state.read("notification_outbox").collect()) == ["NEW", "REVIEW"]


def test_notices_details_and_eligibility(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri(), only_enrollable_new=True)
    e.run(observed(spark, [{}]), TODAY, NOW)
    e.dispatch(e.claim(5, NOW), lambda m: "m", NOW, 0)
    notice = {"source": "boja", "external_id": "n", "summary": "Corrección de errores"}
    for _ in range(2):  # the second time the item is known: no second update
        e.run(observed(spark, [notice]), TODAY, NOW, reports={"boja": {"warning": "index lags"}, "martos": {"error": "bearer abcdefghijkl failed"}, "boe": {"failed": dt.date(2026, 10, 18), "warning": "1 unreadable"}})
    box = e.events(["PENDING"]).collect()
    assert [(r.kind, json.loads(r.payload)["changes"]) for r in box] == [("UPDATE", ["correccion o rectificacion oficial"])]
    later = {"source": "bop_jaen", "external_id": "p", "full_text": "Acceso libre. Plazo de presentación hasta el 05/11/2026. Requisito: bachiller."}
    e.run(observed(spark, [later]), TODAY, NOW)
    e.run(observed(spark, [{**later, "full_text": later["full_text"].replace("05/11", "09/11")}]), TODAY, NOW)
    (row,) = e.events(["PENDING"]).collect()
    payload = json.loads(row.payload)
    assert payload["changes"] == ["correccion o rectificacion oficial", "fecha limite"]
    assert [(d["field"], d["old"], d["new"], d["source_reference"]) for d in payload["change_details"]] == [("deadline", "2026-10-30", "2026-11-09", "p")]
    assert "30/10/2026 → 09/11/2026" in render.message(row.kind, row.payload)
    points = {r.source: r.covered_through for r in e.state.read("source_checkpoints").collect()}
    assert points == {"boe": TODAY, "bop_jaen": TODAY}  # no evidence and errors moved nothing
    runs = {(r.id, r.source): (r.status, r.covered_through, r.message) for r in e.state.read("source_runs").collect()}
    assert runs[4, "boe"] == ("PARTIAL", dt.date(2026, 10, 17), "1 unreadable") and runs[4, "boja"][:2] == ("PARTIAL", None)
    assert runs[4, "martos"] == ("ERROR", None, "bearer <redacted> failed")
    plan = {r.source: (r.days, r.gap) for r in e.plan(dt.date(2026, 12, 20), ["boe", "boja"]).collect()}
    assert plan == {"boe": (45, 18), "boja": (10, 0)}
    # After the deadline an update still goes out, but a new announcement doesn't.
    e.run(observed(spark, [{"external_id": "q", "title": "Programador informático. Convocatoria", "organisation": "Universidad de Jaén"}]), TODAY, NOW)
    sent = []
    out = e.dispatch(e.claim(5, NOW), lambda m: sent.append(m) or "m", NOW + dt.timedelta(days=40), 0)
    assert (out["SENT"], out["SUPPRESSED"]) == (1, 1) and "Cambios" in sent[0]


def test_status_fold_equals_sequential_model(spark):
    r = random.Random(3)
    names = [*rules.STATUS_RANK, "ANULADA", "SUSPENDIDA", "REABIERTA", "PROPUESTA_NOMBRAMIENTO"]
    rows = [(k, i, r.choice(names)) for k in range(8) for i in range(r.randrange(1, 15))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, i int, s string")

    def fold(old, new):
        if new in rules.EXCEPTIONAL_STATUSES:
            return new
        if old in rules.EXCEPTIONAL_STATUSES:
            return new if new in rules.LEAVING_STATUSES else old
        return new if rules.STATUS_RANK.get(new, 0) >= rules.STATUS_RANK.get(old, 0) else old

    want = {}
    for k, _, s in rows:
        want[k] = fold(want.get(k, rules.STATUS_OTHERWISE), s)
    assert {x.k: x.final_status for x in merge.status_fold(df, "k", ["i"], "s").collect()} == want
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    assert all(x.c == fold(x.a, x.b) for x in pairs.select("a", "b", merge.prefer_status(F.col("a"), F.col("b")).alias("c")).collect())


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, first string")
    new = spark.createDataFrame([("b", None, "n"), ("c", 3, "n")], "k string, v int, first string")
    assert sorted(map(tuple, upsert.upsert(old, new, ["k"], ["first"]).collect())) == [("a", 1, "x"), ("b", None, None), ("c", 3, "n")]
    d = dt.date
    runs = spark.createDataFrame([("s", "OK", d(2026, 1, 2)), ("s", "ERROR", d(2026, 1, 9)), ("t", "PARTIAL", None)], "source string, status string, covered_through date")
    had = spark.createDataFrame([("s", d(2026, 1, 1)), ("t", d(2026, 1, 5))], "source string, covered_through date")
    assert sorted(map(tuple, upsert.checkpoint_max(had, runs).collect())) == [("s", d(2026, 1, 2)), ("t", d(2026, 1, 5))]


def test_coverage(spark):
    d = lambda s: F.lit(s).cast("date")
    one = lambda *a: tuple(spark.range(1).select(views.coverage(*a).alias("x")).first().x)
    day = dt.date
    assert one(d(None), F.lit(""), d(None), d("2026-10-20")) == (day(2026, 10, 20), "OK")
    assert one(d(None), F.lit("w"), d(None), d("2026-10-20")) == (None, "PARTIAL")
    assert one(d("2026-10-18"), F.lit(""), d(None), d("2026-10-20")) == (day(2026, 10, 18), "PARTIAL")
    assert one(d("2026-10-20"), F.lit("w"), d("2026-10-17"), d("2026-10-20")) == (day(2026, 10, 16), "PARTIAL")


def test_html(spark):
    page = '<html><head><meta property="article:published_time" content="2026-01-02"></head><body><script>x</script><ul><li>Plaza <a href="/a.pdf#x">Bases</a> hoy</li></ul><a href="#t">t</a><a href="mailto:a@b">m</a><a href="https://o.org/b">B &amp; C</a><a href="/a.pdf">again</a></body></html>'
    text, links, published = html.parse(page, "https://e.org/d/")
    assert "x" not in text.split() and "B & C" in text and published == "2026-01-02"
    assert [(x["url"], x["text"], x["context"]) for x in links] == [("https://e.org/a.pdf", "Bases", "Plaza Bases hoy"), ("https://o.org/b", "B & C", "B & C")]
    rows = html.read_pages(spark.createDataFrame([(1, None, None), (2, "https://e.org", page)], "page_id long, url string, html string"))
    got = {r.page_id: r for r in rows.collect()}
    assert got[1].text == "" and got[1].near_empty and got[1].links == [] and len(got[2].links) == 2
    assert html.links(rows).count() == 2


def test_splitter(spark):
    body = "índice\nAYUNTAMIENTO DE MARTOS\n2026/1\ncuerpo uno\nmás\nUNIVERSIDAD DE JAÉN\n2026/2\ncuerpo dos"
    got = splitter.edicts(spark.createDataFrame([(1, body)], "id int, text string"), "id", "text").orderBy("part").collect()
    assert [(r.reference, r.organisation, r.body) for r in got] == [("2026/1", "AYUNTAMIENTO DE MARTOS", "cuerpo uno\nmás\nUNIVERSIDAD DE JAÉN"), ("2026/2", "UNIVERSIDAD DE JAÉN", "cuerpo dos")]


def test_feeds(spark):
    item = lambda i: {"identificador": f"BOE-A-{i}", "titulo": f"t{i}", "url_html": "h", "url_pdf": {"texto": "p"}}
    day = {"data": {"sumario": {"diario": {"seccion": [{"codigo": "2B", "departamento": {"nombre": "D", "epigrafe": [{"nombre": "E", "item": item(1)}, {"nombre": "F", "item": [item(2), item(3)]}]}}, {"codigo": "3", "departamento": []}]}}}}
    df = spark.createDataFrame([(dt.date(2026, 1, 1), json.dumps(day)), (dt.date(2026, 1, 2), "{broken"), (dt.date(2026, 1, 3), None)], "day date, raw string")
    got = feeds.indexes(df).collect()
    assert [r.id for r in got if r.error is None] == ["BOE-A-1", "BOE-A-2", "BOE-A-3"] and [r.day for r in got if r.error] == [dt.date(2026, 1, 2)]
    assert feeds.unwrap({"Results": 1}) == [{"Results": 1}] and feeds.unwrap({"items": [{"a": 1}, 3]}) == [{"a": 1}]
    assert feeds.get({"ID": 1, "id": 2}, "id") == 2 and feeds.get({"Slug": "s"}, "slug") == "s"
    assert feeds.embedded("x; var d = [{\"a\": 1}, 2]; y", "d") == [{"a": 1}] and feeds.embedded("", "d") == []
    when = spark.createDataFrame([((2026, 2, 3),), ((2026, 2, 31),)], "x struct<year:int,month:int,day:int>")
    assert [r.d for r in when.select(feeds.struct_date(F.col("x")).alias("d")).collect()] == [dt.date(2026, 2, 3), None]


def test_paged_source():
    client = lambda rows, total=None: lambda start, stop, page, size: {"total_hits": len(rows) if total is None else total, "results": rows[page * size : page * size + size]}
    import sys
    import types

    module = types.ModuleType("fake_client")
    sys.modules["fake_client"] = module
    reader = paged.PagedReader({"client": "fake_client:get", "start": "2026-01-01", "stop": "2026-01-25", "page_size": "2", "source": "s"})
    assert [(p.start, p.stop) for p in reader.partitions()] == [("2026-01-01", "2026-01-10"), ("2026-01-11", "2026-01-20"), ("2026-01-21", "2026-01-25")]
    rows = [{"id": i, "date": "2026-01-01"} for i in range(5)]
    module.get = client(rows)
    assert [r[2] for r in reader.read(reader.partitions()[0])] == ["0", "1", "2", "3", "4"]
    for bad in (client(rows, 9), client([{"id": 1}]), lambda *a: {"results": []}):
        module.get = bad
        with pytest.raises(ValueError):
            list(reader.read(reader.partitions()[0]))


CLIENT = """
from datetime import date, timedelta

def get(start, stop, page, size):
    a, b = date.fromisoformat(start), date.fromisoformat(stop)
    with open({log!r}, "a") as f:
        f.write(f"{{start}} {{stop}} {{page}}\\n")
    if (b - a).days < 2:
        raise ValueError("window too short")
    if a <= date(2026, 1, 13) <= b:
        raise OSError("down")
    rows = [{{"id": f"{{a + timedelta(i)}}-{{k}}", "date": str(a + timedelta(i))}} for i in range((b - a).days + 1) for k in range(3)]
    return {{"total_hits": len(rows) + (5 if a <= date(2026, 1, 19) <= b else 0), "results": rows[page * size : page * size + size]}}

def page(url):
    with open({log!r}, "a") as f:
        f.write(url + "\\n")
    if "bad" in url:
        raise OSError("gone")
    return "" if "empty" in url else "text of " + url
"""


@pytest.fixture
def client(tmp_path, monkeypatch):
    """A service as a module that Python workers can import too, and its log of requests."""
    import sys

    name = f"service_{tmp_path.name}"
    (tmp_path / f"{name}.py").write_text(CLIENT.format(log=str(tmp_path / "log")).replace("\\\\n", "\\n"))
    (tmp_path / "log").touch()
    monkeypatch.syspath_prepend(str(tmp_path))
    yield str(tmp_path), name, lambda: (tmp_path / "log").read_text().split("\n")[:-1]
    sys.modules.pop(name, None)


def test_reader_deals_pages_and_gives_evidence(client):
    _, name, log = client
    options = {"client": f"{name}:get", "start": "2026-01-01", "stop": "2026-01-25", "window_days": "5", "page_size": "4", "source": "s", "pages_per_task": "2", "evidence": "true"}
    reader = paged.PagedReader(options)
    parts = reader.partitions()
    assert [(p.start, p.first, p.last) for p in parts if p.start < "2026-01-11"] == [("2026-01-01", 0, 2), ("2026-01-01", 2, 4), ("2026-01-06", 0, 2), ("2026-01-06", 2, 4)]
    rows = [r for p in parts for r in reader.read(p)]
    assert sum(r[0] == "evidence" for r in rows) == len(parts) and sum(r[0] == "data" for r in rows) == 4 * 15 and len(log()) > 10
    short = paged.PagedReader(options | {"stop": "2026-01-06", "least_days": "4", "pages_per_task": "0", "evidence": "false"})
    own = [r for p in short.partitions() for r in short.read(p)]
    assert len(own) == 18 and [(p.start, p.low) for p in short.partitions()] == [("2026-01-01", "2026-01-01"), ("2026-01-03", "2026-01-06")]


def test_coverage_follows_what_was_read(spark, client):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    _, name, _ = client
    options = {"client": f"{name}:get", "start": "2026-01-01", "stop": "2026-01-25", "window_days": "5", "page_size": "4", "source": "s", "pages_per_task": "2", "evidence": "true"}
    schema = paged.PagedJson({}).schema()
    read = lambda **o: spark.createDataFrame([r for reader in [paged.PagedReader(options | o)] for p in reader.partitions() for r in reader.read(p)], schema)
    assert [tuple(r) for r in paged.coverage(read(stop="2026-01-10")).collect()] == [("s", dt.date(2026, 1, 10), None, "")]
    (r,) = paged.coverage(read()).collect()
    assert (r.covered_through, r.failed) == (None, dt.date(2026, 1, 11)) and "down" in r.warning
    (r,) = paged.coverage(read(start="2026-01-16")).collect()
    assert r.failed == dt.date(2026, 1, 16) and r.warning.startswith("ValueError: ") or "records of" in r.warning
    both = read(stop="2026-01-10")
    assert paged.data(both.unionByName(both)).count() == 30
    # What reaches the reader narrows the days, and goes back to be applied to rows.
    reader = paged.PagedReader(options | {"evidence": "false"})
    filters = [GreaterThanOrEqual(("day",), dt.date(2026, 1, 3)), LessThan(("day",), dt.date(2026, 1, 9)), EqualTo(("source",), "s")]
    assert list(reader.pushFilters(filters)) == filters and (str(reader.start), str(reader.stop)) == ("2026-01-03", "2026-01-08")


def test_conditions_reach_the_source(spark, client):
    path, name, log = client
    spark.sparkContext.addPyFile(f"{path}/{name}.py")
    spark.dataSource.register(paged.PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("paged_json").options(client=f"{name}:get", start="2026-01-01", stop="2026-01-25", window_days="5", page_size="50", source="s", least_days="4").load()
    assert df.where("day >= DATE '2026-01-03' AND day < DATE '2026-01-05'").count() == 6
    assert log() == ["2026-01-01 2026-01-04 0"]


def test_pages_are_asked_for_once(spark, client):
    from noticeforge.sources import hydrate

    path, name, log = client
    spark.sparkContext.addPyFile(f"{path}/{name}.py")
    urls = [f"https://h{i % 3}.org/{w}" for i, w in enumerate(["a", "b", "c", "d", "bad", "empty", "a", "b"])] + ["https://skip.org/x", "no host", None]
    notices = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "seq long, url string").repartition(4)
    none = spark.createDataFrame([], hydrate.PAGE)
    wanted = ~F.col("url").contains("skip")
    pages = spark.createDataFrame(hydrate.fetch(hydrate.missing(notices, none, wanted), f"{name}:page", per_host=2, tasks=3).collect(), hydrate.PAGE)
    assert sorted(log()) == sorted({u for u in urls if u and u.startswith("http") and "skip" not in u})
    assert hydrate.missing(notices, pages, wanted).count() == 0
    got = {r.seq: (r.body, r.error) for r in hydrate.hydrated(notices, pages).collect()}
    assert got[0] == ("text of https://h0.org/a", None) and got[5] == ("", None) and "gone" in got[4][1] and got[8] == got[9] == got[10] == (None, None) and len(got) == len(urls)
    origin = pages.where("url LIKE '%bad'").withColumns({"body": F.lit("kept"), "error": F.lit(None).cast("string")})
    via = {r.url: (r.body, r.route, r.failures) for r in hydrate.routed([pages, origin, origin]).collect()}
    assert via["https://h1.org/bad"] == ("kept", 1, ["OSError: gone"]) and via["https://h2.org/empty"] == ("", 0, [])
    assert {r.url: r.route for r in hydrate.routed([pages]).collect()}["https://h1.org/bad"] is None


def test_stream_equals_table(spark, tmp_path):
    """Corrections of known items update in the stream; two batches give the entities that one gives."""
    day = lambda d: f"Acceso libre. Plazo de presentación hasta el {d}/11/2026. Requisito: bachiller."
    rows = observed(spark, [{"full_text": day("05")}, {"full_text": day("05")}, {"external_id": "e0", "full_text": day("09")}, {"external_id": "z", "source": "boja", "group": "c1", "full_text": day("09")}])
    rows = rows.withColumn("external_id", F.when(F.col("seq") < 3, "e0").otherwise("z"))
    (tmp_path / "in").mkdir()
    for part in ("seq < 2", "seq >= 2"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    streamed = Engine(spark, (tmp_path / "a").as_uri())
    ingest.stream(spark, f"{tmp_path}/in", OBSERVATION, f"{tmp_path}/ck", ingest.into(streamed, lambda: NOW), files=1).awaitTermination(300)
    whole = Engine(spark, (tmp_path / "b").as_uri())
    whole.run(rows, TODAY, NOW)
    for e in (streamed, whole):
        (p,) = e.state.read("processes").collect()  # 'C1' and 'c1' are one group
        assert str(p.deadline) == "2026-11-09" and e.state.read("source_items").count() == 2
    assert streamed.state.version() == 2 and streamed.stats() == whole.stats()


def test_notices_of_a_run_meet_each_other(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    rows = [
        {"external_id": "a"},
        {"external_id": "b"},  # the same title in the same source under another id
        {"external_id": "c", "source": "boja", "title": "Programador informático. Convocatoria", "organisation": "Universidad de Jaén", "reference": "BOE-A-2026-9"},
        {"external_id": "d", "source": "bop_jaen", "title": "Analista de sistemas informáticos. Convocatoria", "organisation": "Diputación de Jaén", "reference": "BOE-A-2026-9"},
        {"external_id": "f", "source": "boja", "title": "Técnico Auxiliar de Informática: convocatoria de 3 plazas"},
        {"external_id": "g", "source": "iaap", "title": "Convocatoria de 9 plazas de Técnico Auxiliar de Informática", "full_text": "Acceso libre. 9 plazas. Plazo de presentación hasta el 30/10/2026. Requisito: bachiller."},
    ]
    report = e.run(observed(spark, rows), TODAY, NOW)
    items = {r.external_id: r.process_id for r in e.state.read("source_items").collect()}
    assert items["a"] != items["b"] and items["c"] == items["d"] and items["f"] in (items["a"], items["b"]) and items["g"] not in (items["a"], items["b"])
    assert sum(s["created"] for s in report["sources"].values()) == 4 == e.state.read("processes").count()


def test_exam_dates_stop_being_provisional(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    said = "Acceso libre. Requisito: bachiller. El examen se celebrará el 12/12/2026"
    e.run(observed(spark, [{"full_text": f"{said} (fecha provisional)."}]), TODAY, NOW)
    (p,) = e.state.read("processes").collect()
    assert json.loads(p.snapshot)["exam_date_provisional"] is True and str(p.exam_date) == "2026-12-12"
    e.dispatch(e.claim(5, NOW), lambda m: "m", NOW, 0)
    e.run(observed(spark, [{"full_text": f"{said}."}]), TODAY, NOW)
    (event,) = e.events(["PENDING"]).collect()
    payload = json.loads(event.payload)
    assert event.kind == "UPDATE" and payload["changes"] == ["carácter provisional del examen"]
    assert [(d["field"], d["old"], d["new"]) for d in payload["change_details"]] == [("exam_date_provisional", "true", "false")]
    e.run(observed(spark, [{"full_text": "Acceso libre. Requisito: bachiller."}]), TODAY, NOW)
    (p,) = e.state.read("processes").collect()  # a notice without a date keeps both
    assert json.loads(p.snapshot)["exam_date_provisional"] is False and str(p.exam_date) == "2026-12-12"


def test_folders_and_repairs(spark, tmp_path):
    e = Engine(spark, tmp_path.as_uri())
    folder = "https://www.martos.es/download/12/convocatoria-plaza-informatico"
    rows = [{"source": "ayuntamiento_martos", "external_id": k, "title": f"Programador informático {w}. Convocatoria", "organisation": o, "url": u} for k, w, o, u in [("a", "alfa", "Ayuntamiento de Martos", "https://e.org/a"), ("b", "beta", "Universidad de Jaén", f"{folder}/b.pdf"), ("c", "gamma", "Diputación de Jaén", f"{folder}/c.pdf")]]
    e.run(observed(spark, rows), TODAY, NOW)
    ids = {r.external_id: r.process_id for r in e.state.read("source_items").collect()}
    field = lambda n, v: f'<div class="field field--name-field-{n}"><div class="field__item">{v}</div></div>'
    page = lambda h: f"<h1>{h}</h1>" + field("tipo-de-acceso", "Acceso libre y promoción interna") + field("plazas-totales", "12") + field("estado", "Abierto") + '<table><tr><td class="views-field-field-tipo-de-plazo">Presentación de solicitudes de participación</td><td><time datetime="2026-10-01">a</time><time datetime="2026-11-30T00:00">b</time></td></tr></table>'
    proof = lambda *x: spark.createDataFrame(list(x), "url string, html string")
    version = e.state.version()
    for bad in (("https://e.org/a", page("Otra cosa")), ("https://e.org/z", page("x")), ("https://e.org/a", "<h1>Programador informático alfa. Convocatoria</h1>")):
        with pytest.raises(ValueError):
            e.repair(proof(bad), NOW)
    good = proof(("https://e.org/a", page("PROGRAMADOR informático alfa: convocatoria")))
    (audit,) = e.repair(good, NOW + dt.timedelta(hours=3), "Junta de Andalucía").collect()
    assert audit.changed and json.loads(audit.before).get("positions") is None and json.loads(audit.after)["positions"] == 12 and e.state.version() == version + 1
    after = {r.id: r for r in e.state.read("processes").collect()}
    assert len(after) == 3 and str(after[ids["a"]].deadline) == "2026-11-30" and after[ids["a"]].organisation == "Junta de Andalucía" and after[ids["a"]].access == "MIXTO" and after[ids["a"]].last_changed == NOW + dt.timedelta(hours=3)
    assert json.loads(after[ids["a"]].snapshot)["positions"] == 12 and e.state.read("processes", version).where("positions = 12").count() == 0
    (again,) = e.repair(good, NOW + dt.timedelta(hours=9), "Junta de Andalucía").collect()
    assert not again.changed and e.state.version() == version + 1
    # Documents of one official folder: the entity seen first stands for all, and takes over who follows.
    first, second = sorted((ids["b"], ids["c"]))
    e.follow(second, NOW)
    e.consolidate("ayuntamiento_martos", NOW)
    assert [(r.alias_id, r.process_id) for r in e.state.read("process_aliases").collect()] == [(second, first)]
    assert [(r.reference, r.process_id) for r in e.state.read("official_references").collect()] == [("MARTOS-CATEGORY-12", first)]
    assert e.is_followed(first) and e.is_followed(second)
    e.consolidate("ayuntamiento_martos", NOW)
    assert e.state.read("process_aliases").count() == 1 and all(r.n == 0 for r in e.check().collect())
