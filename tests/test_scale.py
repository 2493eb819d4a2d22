"""What keeps queries within their limits on large tables: each costly step once for a row, and no files left behind."""

import pytest
from pyspark.sql import functions as F

from noticeforge.functions import classify, extract, text
from noticeforge.operators import scratch, settle
from noticeforge.plans import entities, registry
from noticeforge.sources import bulletin

DATA = "/root/testdata/sf0.001"
NORMALISED = "[^a-z0-9]+"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


@pytest.mark.parametrize("package", ["llm", "operators"])
def test_a_cut_leaves_no_shuffle_files(spark, package):
    if package == "llm":
        from noticeforge.llm import common as scratch_tables
    else:
        scratch_tables = scratch
    out = scratch_tables.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert out.count() == 7 and out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(scratch.CLEANUP, None) is None
    before = shuffles(spark)
    scratch_tables.cut(spark.range(1000).repartition(7, "id"), "dealt")
    assert shuffles(spark) <= before


def test_extract_dates_looks_for_a_deadline_once(spark):
    assert plan(registry.extract_dates(spark, DATA)).count("fin(?:al)?") == 1


def test_signal_excerpt_normalises_once(spark):
    assert plan(registry.signal_excerpt(spark, DATA)).count(NORMALISED) == 1


def test_varied_dates_looks_for_a_deadline_once_on_all_cores(spark):
    df = entities.varied_dates(spark, DATA)
    assert plan(df).count("fin(?:al)?") == 1
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["collect_counters", "decision_reasons"])
def test_evaluate_normalises_each_text_once(spark, name):
    # Eight columns, the milestone and the labels, places, and sentences.
    assert plan(registry.queries()[name](spark, DATA)).count(NORMALISED) <= len(classify.TEXTS) + 4


def test_conflict_anti_makes_keys_once(spark):
    assert "sha2(" not in plan(registry.conflict_anti(spark, DATA))


def test_hits_compute_their_text_once(spark):
    assert "Contains(trim(" not in plan(entities.evidence_terms(spark, DATA))


def test_dates_whose_formats_are_told_by_their_marks(spark):
    cases = {"2020-1-2": "2020-01-02", "2/1/2020": "2020-01-02", "02-01-2020": "2020-01-02", "20200102": "2020-01-02", "2020-01-02T10:00:00Z": "2020-01-02", "el 2-1-2020 a las 9": "2020-01-02", "31/02/2020": None, "": None, None: None, "/": None, "-": None, "2020-13-01": None, "+2020": None}
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, x string").select("k", text.parse_date(F.col("x")).cast("string").alias("d")).collect()
    assert [r["d"] for r in sorted(rows)] == list(cases.values())


def test_periods_are_read_from_their_own_match(spark):
    cases = {"El plazo será de veinte días hábiles desde el siguiente al de su publicación en el BOJA. Otro plazo de 10 días naturales": (20, "habiles", "BOJA"), "plazo: 5 días naturales" + " publicación" * 40: (5, "naturales", ""), "plazo de 10 días hábiles.": None, "": None, None: None}
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, x string").select("k", extract.relative_deadline(F.col("x")).alias("r")).collect()
    assert [r["r"] and (r["r"]["days"], r["r"]["kind"], r["r"]["starts_after"]) for r in sorted(rows)] == list(cases.values())


def test_bulletins_make_lines_once(spark):
    made = []

    def cut(df, name):
        made.append((name, plan(df).count("Generate posexplode")))
        return scratch.cut(df, name)

    text_ = "ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE LA VILLA\nBases\nBOP-2026-1\n2026/1\nTexto de las bases\n2026/9 citado"
    out = bulletin.read(spark.createDataFrame([(1, text_), (2, "2026/1"), (3, None)], "id long, text string"), "id", "text", cut)
    assert sum(n for _, n in made) == 1 and "posexplode" not in plan(out)
    got = {r["id"]: (r["reference"], r["body"], r["error"]) for r in out.collect()}
    assert got == {1: ("BOP-2026-1", "2026/1 Texto de las bases 2026/9 citado", None), 2: (None, None, "no references in the contents"), 3: (None, None, "no edict begins")}


def test_batch_identity_tells_the_first_notice_without_gathering_entities(spark):
    out = plan(entities.batch_identity(spark, DATA))
    assert "Aggregate" not in out and "Window" not in out and out.count("Join") == 1


def test_texts_that_share_nothing_are_their_own_classes(spark):
    from noticeforge.llm import jaccard

    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(rows).collect())) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_settle_lists_columns_as_they_are():
    import pyarrow as pa

    for values, kind in (([1, None, 3, 2**62], pa.int64()), ([0, 7], pa.int32()), ([True, None, False], pa.bool_()), (["a", None, "", "a"], pa.string()), ([None, None], pa.string()), ([], pa.string()), ([["a", None], [], ["a", "b"]], pa.list_(pa.string()))):
        column = pa.array(values, kind)
        assert settle._listed(column) == values and settle._listed(column[1:]) == values[1:]
    assert settle._listed(pa.array([["x"], None, ["y"]])) == [["x"], [], ["y"]]
    assert settle._listed(pa.array([], pa.list_(pa.string()))) == []


def test_batch_identity_sends_no_columns_of_entities(spark):
    assert "spans#" not in plan(entities.batch_identity(spark, DATA))
