"""Evidence that is the same in every run, and suites that scan their sources once."""

import pytest
from pyspark.sql import functions as F

from buildproof.checks.registry import Context
from buildproof.checks.runner import Spec, run_checks
from buildproof.operators.evidence import bottom_k, counted
from buildproof.plans.catalyst import items


def test_the_same_rows_under_any_partitioning(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS g", "map('a', id) AS m", "concat('x', id) AS t")
    want = [r.id for r in bottom_k(df, 20).collect()]
    for other in (df.repartition(11), df.orderBy(F.desc("t")), df.coalesce(1)):
        assert [r.id for r in bottom_k(other, 20).collect()] == want
        n, rows = counted(other, 20)
        assert n == 5000 and [r.id for r in rows] == want
    per = bottom_k(df, 4, per=["g"])
    assert {(r.g, r["count"]) for r in per.groupBy("g").count().collect()} == {(0, 4), (1, 4), (2, 4)}
    assert {r.id for r in per.collect()} == {r.id for r in bottom_k(df.repartition(7, "t"), 4, per=["g"]).collect()}
    assert [r.id for r in bottom_k(df, 2, [F.desc("id")]).collect()] == [4999, 4998]


def test_rows_with_maps_inside_and_variants(spark):
    df = spark.range(40).selectExpr("id", "struct(map('k', id) AS m) AS s", "array(map('k', array(id))) AS a", "map(id, map('x', 1)) AS mm", "parse_json(concat('[', id, ']')) AS v")
    n, rows = counted(df, 3)
    assert n == 40 and [r.id for r in rows] == [r.id for r in counted(df.repartition(6), 3)[1]]


def test_counts_of_few_and_no_rows(spark):
    df = spark.range(30)
    assert counted(df.limit(0), 5) == (0, []) and counted(df.filter("id < 3"), 5)[0] == 3 and counted(df, 0) == (30, [])
    assert counted(df.filter("id < 0"), 5) == (0, []) and counted(df, 30)[0] == 30 and counted(df.groupBy("id").count().filter("count > 1"), 5)[0] == 0


def scans(spark, path, action):
    """How often a folder is scanned by the executions of an action, from their final plans."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    ids = lambda: [(e.executionId(), e.jobs().size()) for e in items(store.executionsList())]
    before = max((k for k, _ in ids()), default=-1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else paths are cut short in plans
    try:
        action()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    bus.waitUntilEmpty(30_000)
    n = 0
    for k, jobs in ids():
        if k > before and jobs:
            n += sum(f"{path}]" in node.desc() for node in items(store.planGraph(k).allNodes()))
    return n


SPECS = [Spec("D-GRAIN-002", {"min_rows": 1}), Spec("D-NULL-001", {"key": ["k"]}), Spec("D-GRAIN-001", {"key": ["k"]}), Spec("D-DUP-001"), Spec("D-DISTINCT-001", {"column": "g", "min": 1}), Spec("D-POS-001", {"columns": ["k"]})]


@pytest.mark.parametrize("n", [3000, 0])
def test_a_suite_scans_its_sources_once(spark, tmp_path, n):
    path = str(tmp_path / "source")
    spark.range(n).selectExpr("id % 1000 AS k", "id % 10 AS g").write.parquet(path)
    source = spark.read.parquet(path)
    build = source.join(spark.range(10).toDF("g"), "g").groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    build = build.union(build.filter("k < 50"))  # two scans of the source in the build itself
    runs = []
    assert scans(spark, path, lambda: runs.append(run_checks(Context(build), SPECS))) in ((2,) if n else (1, 2))
    again = run_checks(Context(build.repartition(5)), SPECS)
    assert [(r.id, r.status, r.observed, r.sample) for r in runs[0].results] == [(r.id, r.status, r.observed, r.sample) for r in again.results]
    assert [r.status for r in runs[0].results] == (["PASS", "PASS", "FAIL", "FAIL", "PASS", "PASS"] if n else ["FAIL", "PASS", "PASS", "PASS", "FAIL", "PASS"])
    grain = runs[0].results[2]
    assert not n or grain.observed.startswith("50 ") and len(grain.sample) == 20


def test_a_bad_metric_or_build_in_a_suite(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, c string")
    build = rows.groupBy("k", "c").count().drop("count").union(rows.limit(1))
    found = run_checks(Context(build), [Spec("D-POS-001", {"columns": ["c"]}), Spec("D-GRAIN-002", {"min_rows": 3}), Spec("D-DUP-001")]).results
    assert [r.status for r in found] == ["ERROR", "PASS", "FAIL"]
    broken = rows.groupBy("k").agg(F.max(F.raise_error(F.lit("stop"))).alias("x"))
    found = run_checks(Context(broken), [Spec("D-GRAIN-002", {"min_rows": 3}), Spec("D-DUP-001")]).results
    assert [r.status for r in found] == ["FAIL", "ERROR"]  # the number of rows can be told without the bad column
