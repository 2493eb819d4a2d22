"""Official pages, bulletins, source choice, reports and the command line."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from noticeforge import cli, reports
from noticeforge.functions import classify
from noticeforge.operators import views
from noticeforge.sources import bulletin, official, registry

DAY = dt.date(2026, 10, 20)


def index(day="20/10/2026"):
    item = lambda n, t: f'<li class="dispo"><p>{t}</p><ul><li class="puntoPDF"><a href="/pdf/BOE-A-2026-{n}.pdf">PDF</a></li><li class="puntoHTML"><a href="/x?id=BOE-A-2026-{n}">Otros</a></li></ul></li>'
    return f"""<html><head><title>BOE.es - Sumario del día {day}</title></head><body><div class="sumario"><h3>I. Disposiciones generales</h3><h4>X</h4><ul>{item(1, "ley")}</ul>
    <h3>II. Autoridades y personal - B. Oposiciones y concursos</h3><h4>Administración Local</h4><h5>Personal funcionario</h5><ul>{item(2, "Resolución del Ayuntamiento de Martos, plazas")}{item(3, "Otra")}</ul><h4>Universidades</h4><ul>{item(4, "U")}</ul></div></body></html>"""


def test_daily_index(spark):
    rows = official.daily_index(index(), DAY)
    assert [(r["id"], r["department"], r["epigraph"], r["section"]) for r in rows] == [("BOE-A-2026-2", "Administración Local", "Personal funcionario", "2B"), ("BOE-A-2026-3", "Administración Local", "Personal funcionario", "2B"), ("BOE-A-2026-4", "Universidades", "", "2B")]
    assert rows[0]["pdf_url"] == "https://www.boe.es/pdf/BOE-A-2026-2.pdf"
    pages = spark.createDataFrame([(1, index(), DAY), (2, index("21/10/2026"), DAY), (3, None, DAY)], "page_id long, html string, day date")
    got = {r.page_id: r for r in official.read(pages, official.daily_index, "day").collect()}
    assert len(json.loads(got[1].found)) == 3 and got[2].error and got[3].error and got[2].found is None
    title = spark.createDataFrame([("Anuncio del Ayuntamiento de  Martos, sobre x",), ("nada",), (None,)], "t string")
    assert [r[0] for r in title.select(official.issuer(F.col("t"))).collect()] == ["Ayuntamiento de Martos", "", ""]


def test_proof_of_a_day():
    link = lambda day: f'<article><a href="descargarws.dip?fechaBoletin={day}&numeroEdicto=12">x</a></article>'
    assert official.proves_day(link("2026-10-20"), DAY) and not official.proves_day(link("2026-10-19"), DAY) and official.proves_day("", DAY)
    assert official.proves_day("<p>No hay ningún boletín publicado para el día 20-10-2026</p>", DAY) and not official.proves_day("<p>error</p>", DAY)


def test_archive_results(spark):
    base = "https://bophistorico.dipujaen.es"
    frame = lambda i, day="20/10/2026", to=None, more="": f'<div class="x list-frame" id="frame-{i}"><div><a id="open-{i}" href="/v?id={to or i}&amp;page=1">o</a></div><a id="download-{i}" href="d.raw?id={i}{more}">d</a><a id="thumbnail-link-{i}" title="Boletín {day}. [Ejemplar]">t</a><p>12 <b>páginas</b></p></div>'
    page = lambda n, *frames: f'<div class="results">Página 1. Resultados: <b>{n}</b></div><hr>' + "".join(frames) + "<p>4 páginas</p>"
    pages = [
        page(1, frame(7)), page(3, frame(7), frame(8, "15/10/2026")), "<p>Su consulta no ha devuelto ningún resultado</p>", page(0, frame(7)), page(2), page(1, frame(7), frame(8)), page(3, frame(7), frame(7)), page(1, frame(7, "01/10/2026")),
        page(1, frame(7, "21/10/2026")), page(1, frame(7, to=8)), page(1, frame(7, more="&id=9")), page(1, frame(7, "31/02/2026")), page(1, frame(7, "ayer")), page(1, frame("x")), page(1, frame(7).replace("download-7", "dl")), '<div class="results">nada</div>', "<p>?</p>", None,
        page(1, frame(7).replace('href="/v', 'href="http://other.org/v')),
    ]
    df = spark.createDataFrame([(i, p, dt.date(2026, 10, 15), DAY) for i, p in enumerate(pages)], "page_id long, html string, start date, stop date").repartition(3)
    got = official.archive_results(df).collect()
    (row,) = [r for r in got if r.page_id == 0]
    assert row[1:] == ("7", DAY, "Boletín 20/10/2026.", 12, f"{base}/v?id=7&page=1", f"{base}/d.raw?id=7", None)
    assert sorted(r.archive_id for r in got if r.page_id == 1) == ["7", "8"] and not [r for r in got if r.page_id == 2]
    assert {r.page_id: r.error for r in got if r.error} == {
        3: "results although there are none", 4: "a total without results", 5: "more results than the total", 6: "repeated id 7", 7: "2026-10-01 is before 2026-10-15", 8: "2026-10-21 is after 2026-10-20", 9: "7 has a link that isn't its own",
        10: "7 has a link that isn't its own", 11: "no such day 31/02/2026", 12: "7 has no date", 13: "bad id x", 14: "7 has no viewer or PDF", 15: "results without a total", 16: "neither results nor an empty search", 17: "neither results nor an empty search", 18: "7 has a link that isn't its own",
    }


def test_process_fields():
    field = lambda n, v: f'<div class="field--name-field-{n}"><div class="field__item">{v}</div></div>'
    row = '<table><tr><td class="views-field-field-tipo-de-plazo">Presentación de solicitudes de participación</td><td><time datetime="2026-10-01T00:00">a</time><time datetime="2026-10-30T00:00">b</time></td></tr></table>'
    got = official.process_fields(field("tipo-de-acceso", "Acceso libre") + field("plazas-totales", "12") + field("estado", "Abierto") + row)
    assert got == {"access_text": "Acceso libre", "positions": 12, "state": "Abierto", "deadline": "2026-10-30"}
    assert official.process_fields(field("tipo-de-acceso", "x") + field("plazas-totales", "12 más"))["positions"] is None and official.process_fields("<p>x</p>") is None


TEXT = """ADMINISTRACIÓN LOCAL
Martes, 20 de octubre de 2026
AYUNTAMIENTO DE MARTOS
Recursos Humanos
Bases de una plaza de
Técnico informático
BOP-2026-11
AYUNTAMIENTO DE JAÉN
Otro asunto
BOP-2026-12
Número 200
2026/11
Bases para la oposición de una plaza. Véase
2026/99
y más texto del primero.
Pág. 3
2026/12 Texto del segundo, largo.
"""


def test_bulletin(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None), (4, TEXT.replace("2026/12 ", "2026/13 "))], "id long, text string")
    rows = bulletin.read(df, "id", "text")
    got = [(r.id, r.part, r.reference, r.title, r.organisation) for r in rows.orderBy("id", "part").collect() if r.error is None]
    assert got == [(1, 1, "BOP-2026-11", "Bases de una plaza de Técnico informático", "AYUNTAMIENTO DE MARTOS - Recursos Humanos"), (1, 2, "BOP-2026-12", "Otro asunto", "AYUNTAMIENTO DE JAÉN")]
    assert {r.id for r in rows.where("error is not null").collect()} == {2, 3, 4}
    own = rows.where("id = 1").select("part", "body", bulletin.is_it_job(F.col("title"), F.col("organisation"), F.col("body")).alias("it")).orderBy("part").collect()
    assert [r.it for r in own] == [True, False] and "2026/99" in own[0].body and "Pág" not in own[0].body
    days = lambda *rows: spark.createDataFrame(list(rows), "published date, failed boolean")
    cover = lambda df: tuple(official.archive_coverage(df, F.lit(dt.date(2026, 10, 10)), F.lit(DAY)).first())
    d = lambda n: dt.date(2026, 10, n)
    assert cover(days((d(20), False))) == ("CURRENT", d(20)) and cover(days((d(18), False))) == ("LAGGING", d(18)) and cover(days((d(18), False)).limit(0)) == ("EMPTY", None)
    assert cover(days((d(20), False), (d(15), True))) == ("PARTIAL", d(14)) and cover(days((d(20), False), (d(10), True)))[1] is None


def test_bulletin_headings(spark):
    """Sections keep the organisation, a reference keeps the department, other headings don't; what is wrong is told by its first place."""
    head = "ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE MARTOS\nÁrea de Personal\nUno\nBOP-2026-1\nÁrea de Hacienda\nServicio de Aguas\nDos\nServicio de nada\nbop 2026/2\nJUNTA DE ANDALUCÍA\nTres\nBOP-2026-3\nCONSORCIO; NADA\nCuatro\nBOP-2026-4\n"
    tail = "".join(f"2026/{i} cuerpo del número {i}, sigue.\n  2026/{i - 1} se cita\n" for i in range(1, 5))
    cases = {1: head + tail, 2: head + "Otra\nBOP-2026-1\n" + tail, 3: head + "BOP-2026-5\n" + tail, 4: head + tail.replace("2026/2 cuerpo", "2027/2 cuerpo"), 5: "Nada\n" + tail, 6: "\r\n\f", 7: head.replace("Tres", "Tres de título largo") + tail.replace(" cuerpo del número 3, sigue.", "").replace("  2026/2 se cita", "")}
    rows = bulletin.read(spark.createDataFrame(list(cases.items()), "id long, text string").repartition(3), "id", "text").collect()
    got = {(r.id, r.part): (r.reference, r.title, r.organisation) for r in rows if r.error is None}
    assert got == {
        (1, 1): ("BOP-2026-1", "Uno", "AYUNTAMIENTO DE MARTOS - Área de Personal"),
        (1, 2): ("BOP-2026-2", "Dos Servicio de nada", "AYUNTAMIENTO DE MARTOS - Servicio de Aguas"),
        (1, 3): ("BOP-2026-3", "Tres", "AYUNTAMIENTO DE MARTOS"),
        (1, 4): ("BOP-2026-4", "Cuatro", "CONSORCIO; NADA"),  # in capitals with a known beginning
    }
    (second,) = [r.body for r in rows if (r.id, r.part) == (1, 2)]
    assert second == "2026/2 cuerpo del número 2, sigue. 2026/1 se cita"
    assert {r.id: r.error for r in rows if r.error} == {2: "BOP-2026-1 is repeated", 3: "BOP-2026-5 has no title", 4: "BOP-2026-4 has no body", 5: "no references in the contents", 6: "no edict begins", 7: "BOP-2026-3 is too short"}
    assert bulletin.read(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
    kinds = spark.createDataFrame([("AYUNTAMIENTO: BASES",), ("AYUNTAMIENTO DE X; Y",), ("LA COMUNIDAD, S.L.",), ("Comunidad",), ("Lunes, 5 de mayo de 2026",)], "x string")
    from noticeforge.functions import text

    assert [r[0] for r in kinds.select(bulletin.line_kind(F.col("x"), text.normalize(F.col("x")))).collect()] == ["title", "organisation", "organisation", "title", "empty"]


def test_choice_and_isolation():
    config = {"sources": {"a": {"kind": "html"}, "b": {"kind": "pag", "enabled": False}, "c": {}}, "x": {"y": 3}}
    readers = {"html": lambda name: [name]}
    assert [s[0] for s in registry.chosen(config, readers)] == ["a", "c"] and [s[0] for s in registry.chosen(config, readers, {"c", "b"})] == ["c"]
    with pytest.raises(ValueError):
        registry.chosen({"sources": {"a": {"kind": "odd"}}}, readers)
    assert registry.setting(config, "x.y") == 3 and registry.setting(config, "x.z.w", 1) == 1

    def ask(reader, name, own):
        if name == "a":
            raise OSError("down")
        return reader(name), {"warning": "w"}

    assert registry.isolated(registry.chosen(config, readers), ask) == (["c"], {"a": {"error": "OSError: down"}, "c": {"warning": "w"}})

    def broken():
        raise OSError("500")

    assert registry.fallback([("api", broken), ("html", lambda: [1])]) == ("html", [1], "api: 500") and registry.fallback([("api", lambda: None)])[1] == []
    with pytest.raises(OSError):
        registry.fallback([("api", broken)])


def test_views_of_links_and_groups(spark):
    links = spark.createDataFrame([("p", 1, "u", "old"), ("p", 2, "v", "1 de mayo de 2026"), ("p", 3, "u", "new"), ("p", 4, "w", "1 de mayo de 2026")], "process_id string, seq int, url string, label string")
    union = views.link_union(links)
    assert [(r.url, r.label) for r in union.orderBy("place").collect()] == [("u", "new"), ("v", "1 de mayo de 2026"), ("w", "1 de mayo de 2026")]
    from noticeforge.functions import text

    assert [(r.url, r.day) for r in views.newest_milestone(union, text.milestone_date(F.col("label"))).collect()] == [("v", "2026-05-01")]
    p = spark.createDataFrame([("a", 1, 5), ("b", 9, 2), ("c", 3, 3)], "id string, last_seen int, last_changed int")
    got = views.alias_groups(p, spark.createDataFrame([("b", "a")], "alias_id string, process_id string"))
    assert {r.id: (r.aliases, r.last_seen, r.last_changed) for r in got.collect()} == {"a": (["b"], 9, 5), "c": ([], 3, 3)}
    t = lambda a, **k: spark.range(1).select(classify.in_window(F.lit(a).cast("date"), F.lit(DAY), F.lit(5), k.get("followed", F.lit(False)), k.get("undated", False), k.get("future", False))).first()[0]
    assert t("2026-10-16") and not t("2026-10-14") and not t("2026-10-21") and t("2026-10-21", future=True) and t(None, undated=True) and not t(None) and t("2020-01-01", followed=F.lit(True))


def test_reports(tmp_path):
    base = {"status": "success", "event": "schedule", "url": "https://e.org/1"}
    found = {"sources_attempted": 2, "fetched": 9, "created": 0, "updated": 0, "errors": {}, "warnings": {}}
    head = lambda **k: reports.render(base | k).split("\n")[0]
    assert head(collection=found) == reports.NOTHING_NEW and head(collection=found | {"created": 1}) == reports.DONE and head(status="failure") == reports.FAILED
    assert head(collection=found | {"errors": {"a": "x", "b": "y"}}) == reports.NO_SOURCES and head(collection=found | {"errors": {"a": "x"}}) == reports.INCOMPLETE
    assert head(collection=found | {"warnings": {"a": "x"}}) == reports.WARNED and head(collection=found | {"created": 1}, delivery={"uncertain": 1}) == reports.UNDELIVERED
    long = reports.render(base | {"collection": found | {"warnings": {f"s{i}": "<&>" * 80 for i in range(50)}}})
    assert len(long) <= reports.MOST_CHARS and long.endswith("https://e.org/1") and not re.search("&(?!lt;|gt;|amp;)", long)
    path = str(tmp_path / "d" / "m.json")
    reports.merge_metrics(path, {"a": 1})
    assert reports.merge_metrics(path, {"b": 2}) == {"a": 1, "b": 2}
    sent = []
    reports.deliver(base, sent.append)
    assert len(sent) == 1


def test_command_line(spark, tmp_path, capsys):
    from test_engine import NOW, observed

    state, batch, metrics = (tmp_path / "state").as_uri(), str(tmp_path / "batch.json"), str(tmp_path / "m.json")
    observed(spark, [{}]).write.parquet(str(tmp_path / "obs"))
    go = lambda *a, **k: cli.main(["--state", state, *a], spark, now=NOW, **k)
    assert go(str(tmp_path / "obs"), "--metrics-file", metrics) == cli.DONE  # run is the default
    assert json.loads(open(metrics).read())["collection"]["created"] == 1
    assert go("outbox", "claim", "--batch-file", batch) == cli.DONE and len(json.loads(open(batch).read())) == 1
    assert go("outbox", "dispatch", "--batch-file", batch) == cli.NO_SINK
    assert go("outbox", "claim", "--batch-file", batch) == cli.DONE

    def cut(_):
        raise OSError("cut")

    assert go("outbox", "dispatch", "--batch-file", batch, make_sink=lambda: cut) == cli.UNCERTAIN
    capsys.readouterr()
    assert go("outbox", "list") == cli.DONE and "UNCERTAIN" in capsys.readouterr().out
    assert go("outbox", "retry", "nobody") == cli.REFUSED and go("catalog", "follow", "zz") == cli.REFUSED and go("db", "check") == cli.DONE
    with pytest.raises(ValueError):
        go("outbox", "dispatch", "--batch-file", batch, config={"delivery_policy": "often"}, make_sink=lambda: cut)


def test_link_scan(spark):
    from noticeforge.sources import elements, linkscan

    job = "Convocatoria de plazas de informática"
    page = f"""<html><head><meta name="date" content="2026-10-05"></head><body><header><a href="/p">{job}</a></header><nav class="card"><a href="/q">{job}</a></nav>
<a href="#top">{job}</a><a href="mailto:a@b">{job}</a><a href=" ">{job}</a>
<table><tr class="x"><td>{job}</td><td><a href="a/1.html#frag">Ver bases</a> <a href="a/1.html">Otra vez</a></td></tr></table>
<div class="Views-Row y"><div><span><a href="../b?x=1">{job}</a></span></div></div><div><p>Oposición</p><a href="/c">Programador informático, convocatoria</a></div>
<ul><li>{job}<a href="/d">Inicio</a></li><li><a href="/e">Conserje</a></li><li>{job} <ul><li><a href="/f">dentro</a></li></ul></li></ul>
<li>{job} <a href="https://e.org/l/listing">esta</a> <a href="http://[bad">mal</a></li></body></html>"""
    df = spark.createDataFrame([(1, "https://e.org/l/listing", page, "s"), (2, "https://e.org/l/two", f'<li>{job} <a href="a/1.html">x</a></li>', "s"), (3, "https://e.org/l/x", None, "s"), (4, "https://e.org/l/y", f'<li>{job} <a href="a/1.html">x</a></li>', "t")], "page_id long, url string, html string, source string").repartition(3)
    got = linkscan.scan(df).collect()
    assert sorted((r.source, r.url, r.title) for r in got) == [
        ("s", "https://e.org/b?x=1", job),
        ("s", "https://e.org/c", "Programador informático, convocatoria"),
        ("s", "https://e.org/l/a/1.html", "Ver bases"),
        ("s", "https://e.org/p", job),
        ("s", "https://e.org/q", job),
        ("t", "https://e.org/l/a/1.html", "x"),
    ]
    by = {(r.source, r.url): r for r in got}
    assert by["s", "https://e.org/l/a/1.html"].context == f"{job} Ver bases Otra vez" and by["s", "https://e.org/p"].context == "" and by["s", "https://e.org/c"].context == "Oposición Programador informático, convocatoria"
    assert len({r.external_id for r in got}) == 6 and all(len(r.external_id) == 32 for r in got)
    links = linkscan.contexts(elements.elements(df, url_col="url")).where("key = 1 AND title = 'dentro'").first()
    assert links.context == "dentro"  # the nearest item, not the one around it
    row = lambda *x: spark.createDataFrame([x], "s string, u string, l string").select(linkscan.may_hydrate(F.col("s"), F.col("u"), F.col("l"))).first()[0]
    assert row("s", "https://E.org/x", "https://e.org/l") and not row("s", "https://o.org/x", "https://e.org/l") and not row("s", "https://e.org/x.DOCX", "https://e.org/l") and not row(linkscan.BLOCKED, "https://e.org/x", "https://e.org/l") and not row("s", None, "https://e.org/l")
    dated = [(1, page), (2, '<time datetime="bad"></time><time datetime="2026-10-07T10:00"></time><meta name="date" content="2026-10-05">'), (3, "<p>Publicado el día <b>3/10/2026</b></p>"), (4, "<p>nada</p>"), (5, '<meta itemprop="datePublished" content="2026-10-01"><meta property="article:published_time" content="2026-10-02">')]
    days = linkscan.published(elements.elements(spark.createDataFrame(dated, "page_id long, html string"))).collect()
    assert {r.key: str(r.published) for r in days} == {1: "2026-10-05", 2: "2026-10-07", 3: "2026-10-03", 4: "None", 5: "2026-10-02"}


def test_live_site_or_archive(spark):
    d = lambda n: dt.date(2026, 10, n)
    live = spark.createDataFrame([("a", d(10), d(20), None, None), ("b", d(10), d(20), None, d(15)), ("c", d(10), d(20), None, d(10)), *((s, d(10), d(20), "OSError: down", None) for s in "efghi")], "source string, start date, stop date, error string, failed date")
    archive = spark.createDataFrame([("a", "LAGGING", d(11)), ("e", "CURRENT", d(20)), ("f", "LAGGING", d(18)), ("g", "EMPTY", None), ("h", "PARTIAL", d(14))], "source string, status string, covered_through date")
    got = {r.source: r for r in official.live_or_archive(live, archive).collect()}
    assert {s: (r.route, r.covered_through) for s, r in got.items()} == {"a": ("live", d(20)), "b": ("live", d(14)), "c": ("live", None), "e": ("archive", d(20)), "f": ("archive", d(18)), "g": ("archive", None), "h": ("archive", d(14)), "i": ("archive", None)}
    assert got["a"].warning == got["e"].warning == "" and "2026-10-18; 2026-10-20" in got["f"].warning and "2026-10-10 to 2026-10-20" in got["g"].warning and "2026-10-14" in got["h"].warning and "down" in got["i"].warning and "2026-10-15" in got["b"].warning
