"""Pairs of input and expected value for the extraction and classification rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.functions import classify, extract, identity, render, rules, text


def values(spark, pairs, build):
    rows = [(i, x) for i, (x, _) in enumerate(pairs)]
    got = spark.createDataFrame(rows, "i int, x string").select("i", build(F.col("x")).alias("y")).collect()
    return {r["i"]: r["y"] for r in got}


def check(spark, pairs, build):
    got = values(spark, pairs, build)
    for i, (x, want) in enumerate(pairs):
        y = got[i]
        y = y.asDict() if hasattr(y, "asDict") and want is not None else y
        assert y == want, (x, y, want)


def test_normalisation(spark):
    check(spark, [("  Técnico/a  de SISTEMAS ", "tecnico a de sistemas"), (None, ""), ("Nº 3ª", "no 3a"), ("ñandú—ÜBER", "nandu uber")], text.normalize)
    check(spark, [("a  b\n\tc ", "a b c"), (None, "")], text.clean)
    check(spark, [("BOE-A-2024/12 é", "BOEA202412E")], text.normalize_reference)
    check(spark, [("en 2024 y 2025", "2024"), ("12024", ""), (None, "")], text.extract_year)
    check(spark, [("Resolución por la que se convoca 3 plazas de Técnico 2024", "3 plazas de tecnico".replace("3 ", ""))], text.title_signature)


def test_parse_date(spark):
    d = dt.date
    pairs = [("2024-03-05", d(2024, 3, 5)), ("5/3/2024", d(2024, 3, 5)), ("05-03-2024", d(2024, 3, 5)), ("20240305", d(2024, 3, 5)), ("2024-03-05T10:00:00Z", d(2024, 3, 5)), ("hasta el 5/3/2024 a las 9", d(2024, 3, 5)), ("31/02/2024", None), ("", None), (None, None), ("nada", None)]
    check(spark, pairs, text.parse_date)
    check(spark, [("Lista de fecha 5 de marzo de 2024", "2024-03-05"), ("31 de febrero de 2024", ""), ("x", "")], text.milestone_date)


def test_hashes(spark):
    import hashlib
    import json

    row = spark.range(1).select(text.stable_hash(text.canonical_json(F.lit("á\"").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(True).alias("c"))).alias("h"), text.string_hash(F.lit("ñ/x")).alias("s")).first()
    assert row.h == hashlib.sha256(json.dumps({"a": 'á"', "b": None, "c": True}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert row.s == hashlib.sha256('"ñ/x"'.encode()).hexdigest()


def test_extraction(spark):
    d = dt.date
    check(spark, [("Grupo C1", "C1"), ("cuerpo B1.2000", "B"), ("C1.2003 opción", "C1"), ("nivel B1", "")], extract.group)
    check(spark, [("12 plazas", 12), ("plazas: 7", 7), ("dos plazas", 2), ("ninguna", None)], extract.positions)
    check(
        spark,
        [
            ("Plazo de presentación: del 01/10/2026 al 20/10/2026.", {"date": d(2026, 10, 20), "confirmed": True}),
            ("Fin del plazo 5-11-2026", {"date": d(2026, 11, 5), "confirmed": True}),
            ("solicitudes según anuncio publicado en el BOP de 02/10/2026", {"date": None, "confirmed": False}),
            ("sin fecha", {"date": None, "confirmed": False}),
        ],
        extract.deadline,
    )
    got = values(spark, [("Plazo de veinte días hábiles desde la publicación en el BOE", 0), ("plazo de 10 días naturales", 0), ("plazo: 15 días naturales a contar del siguiente en BOJA", 0)], extract.relative_deadline)
    assert (got[0].days, got[0].kind, got[0].starts_after) == (20, "habiles", "BOE")
    assert got[1] is None and (got[2].days, got[2].kind, got[2].starts_after) == (15, "naturales", "BOJA")
    exam = "El examen tendrá lugar el 12/05/2026 a las 9:30 en Sede: IES Virgen. "
    check(spark, [(exam, d(2026, 5, 12)), ("pruebas selectivas convocadas por Resolución de 12/05/2026", None)], extract.exam_date)
    check(spark, [(exam, "09:30"), ("nada", None)], extract.exam_time)
    check(spark, [(exam, "IES Virgen"), ("Examen en el aula A1 a las 10:00", "aula A1"), ("nada", "")], extract.exam_place)
    check(spark, [("El examen, fecha prevista", True), ("el examen es el lunes", False), (None, False)], extract.exam_is_provisional)
    check(spark, [("BOP 2024-3 y BOE-A-2024-5, BOE-A-2024-5", ["BOEA20245", "BOP20243"]), (None, [])], extract.references)
    check(spark, [("x " * 30 + "requisito titulación: bachiller", ("x " * 30 + "requisito titulación: bachiller")[10:].strip()), ("", "")], extract.qualification)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Requisito: título de Bachiller.", rules.COMPATIBLE),
        ("Se exige licenciatura.", rules.NOT_COMPATIBLE),
        ("Se exige licenciatura o equivalente, o bachiller.", rules.COMPATIBLE),
        ("Se exige licenciatura y bachiller.", rules.REVIEW),
        ("Se exige licenciatura. Se exige bachiller.", rules.REVIEW),
        ("Se valorará el bachiller.", rules.REVIEW),
        ("Bachiller.", rules.COMPATIBLE),
        ("", rules.REVIEW),
    ],
)
def test_qualification(spark, raw, want):
    assert spark.range(1).select(classify.qualification(F.lit(raw), F.lit(True)).alias("q")).first().q == want


def test_access_status_signals(spark):
    n = lambda f: lambda x: f(text.normalize(x))
    check(spark, [("Acceso libre", rules.OPEN), ("promoción interna", rules.INTERNAL_ONLY), ("turno libre y promoción interna", rules.MIXED), ("No es de promoción interna", rules.UNKNOWN_ACCESS), ("", rules.UNKNOWN_ACCESS)], n(classify.access))
    check(spark, [("Anulación de la convocatoria", "ANULADA"), ("Convocatoria", "CONVOCADA"), ("Propuesta de nombramiento y fecha de examen", "PROPUESTA_NOMBRAMIENTO"), ("x", "DETECTADA")], n(classify.status))
    check(spark, [("Administración de Justicia", False), ("nota informativa", False), ("técnicos de sistemas", True), ("puesto TIC", True)], n(classify.has_it_signal))
    check(spark, [("Ayudantes técnicos - Opción Informática", True), ("C1.2003 Informática", True), ("Conserje", False), ("Analista Programador", True)], classify.is_it_role_title)


def test_windows_and_gates(spark):
    t = F.lit(dt.date(2026, 10, 20))
    day = lambda n: F.lit(dt.date(2026, 10, 20) - dt.timedelta(n))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    w = lambda published, kind="habiles", source="boe", after="BOE": one(classify.window_open(F.lit(source), F.lit("PLAZO_ABIERTO"), F.lit(rules.OPEN), F.lit(False), day(published), F.lit(20), F.lit(kind), F.lit(after), t))
    assert w(35) and not w(36) and w(23, "naturales") and not w(24, "naturales") and w(52, after="BOP") and not w(53, after="BOP") and not w(-1)
    a = lambda deadline, published: one(classify.can_apply(F.lit("PLAZO_ABIERTO"), F.lit(rules.OPEN), F.lit(True), deadline, published, t))
    assert a(day(0), F.lit(None).cast("date")) and not a(day(1), day(9)) and not a(day(0), day(-1)) and not a(F.lit(None).cast("date"), day(1))
    ts = lambda s: F.to_timestamp(F.lit(s))
    assert one(classify.schedule_gate(F.lit(6), ts("2026-07-01 00:00:00"))) and not one(classify.schedule_gate(F.lit(6), ts("2026-12-01 00:00:00")))
    assert one(classify.schedule_gate(F.lit(7), ts("2026-12-01 00:00:00"))) and one(classify.schedule_gate(F.lit(None).cast("int"), ts("2026-12-01 00:00:00")))


def test_similarity_and_details(spark):
    s = identity.token_set_similarity
    assert s("a b", "a b c") == 100 and s("", "a") == 0 and s("tecnico de sistemas", "sistemas tecnico de") == 100
    assert round(s("abc", "abd"), 3) == round(200 * 2 / 6, 3)
    lcs = lambda a, b: max((0, *(1 + lcs(a[i + 1 :], b[b.index(c) + 1 :]) for i, c in enumerate(a) if c in b)))
    for a, b in (("kitten", "sitting"), ("abcbdab", "bdcaba"), ("x", "y")):
        assert identity._indel(a, b) == 200.0 * lcs(a, b) / (len(a) + len(b))
    kind = "array<struct<field:string,label:string,old:string,new:string>>"
    df = spark.createDataFrame([([("a", "A", "1", "2"), ("b", "B", "1", "2")], [("a", "A", "2", "3"), ("b", "B", "2", "1"), ("c", "C", None, "9")])], f"p {kind}, c {kind}")
    got = df.select(identity.merge_details(F.col("p"), F.col("c")).alias("m")).first().m
    assert [(x.field, x.old, x.new) for x in got] == [("a", "1", "3"), ("c", None, "9")]


def test_render_and_redact(spark):
    assert render.escaped("a<b" * 9, 10) == "a&lt;ba…" and render.escaped("ab", 2) == "ab"
    assert len(render.message("NEW", '{"title": "' + "&" * 3000 + '", "links": [{"url": "javascript:x"}, {"url": "https://e.org/a"}]}')) <= render.MOST_CHARS
    check(spark, [("Bearer abcdefgh12345", "Bearer <redacted>"), ("/bot12345678901234567890abc/x", "<redacted>x"), ("nada", "nada")], text.redact_secrets)
    check(spark, [("a<b" * 9, "a&lt;ba…"), ("ab", "ab")], lambda x: text.escape_limited(x, 10))
    url = "https://www.martos.es/download/12/convocatoria-plaza-informatico%20x/y.pdf"
    got = values(spark, [(url, 0), ("https://example.org/download/12/convocatoria-plaza-informatic/y", 0), (None, 0)], text.folder_of)
    assert (got[0].id, got[0].title) == ("12", "Convocatoria plaza informatico x") and got[1] is None and got[2] is None


def test_keyboard():
    import json

    from noticeforge.functions import render

    own = "0123abcd-0000-1111-2222-0123456789ab"
    rows = render.keyboard(json.dumps({"process_id": own, "links": [{"url": "javascript:x"}, {"url": "https://e.org/a"}]}))["inline_keyboard"]
    assert [r[0]["text"] for r in rows] == [render.DETAILS, render.FOLLOW, render.OFFICIAL, render.COPY] and rows[2][0]["url"] == "https://e.org/a" and rows[0][0]["callback_data"] == f"d:{own}:a:1"
    assert len(render.keyboard(json.dumps({"process_id": "a" * 32}))["inline_keyboard"]) == 3 and render.keyboard(json.dumps({"process_id": "zz"})) is None and render.keyboard("{}") is None
