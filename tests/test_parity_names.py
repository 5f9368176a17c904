"""Names in parity runs and metadata checks: full ones, in any case, and those that aren't there."""

import pytest
from pyspark.sql import functions as F

from buildproof.checks.estate import Listed, NoSuchObject, clashes, read_object, run_parity
from buildproof.checks.migration import check_object, save_snapshot
from buildproof.checks.registry import Context
from buildproof.checks.runner import Spec, run_checks
from buildproof.operators.parity import compare_metrics, compare_rows, measure, spelled
from buildproof.operators.regression import fingerprint, fingerprint_breaches, row_changes
from buildproof.plans.static import mismatched_keys
from buildproof.sources.baseline import BaselineStore
from buildproof.sources.mapping import Entry

from .test_runs import _workbook


def test_an_object_is_never_compared_with_itself_for_want_of_its_target(spark, tmp_path):
    legacy = spark.range(20).selectExpr("id AS k", "id * 2 AS v")
    legacy.createOrReplaceTempView("parity_orders")
    with pytest.raises(NoSuchObject):
        read_object(spark, "NEW_DB.SALES.PARITY_ORDERS")
    _workbook(tmp_path / "w.twb", ["parity_orders"])
    (tmp_path / "m.yml").write_text("version: 1\nobjects:\n  - {old: DB.S.parity_orders, new: NEW_DB.SALES.parity_orders, keys: [k]}\n")
    store, listed = BaselineStore(spark, str(tmp_path / "s")), Listed(str(tmp_path / "w.twb"), str(tmp_path / "m.yml"))
    found = run_parity(spark, listed, store, tables={"db.s.parity_orders": legacy})
    schema = [r for r in found if r.id == "M-SCHEMA-001"]
    assert [(r.status, r.severity, r.observed) for r in schema] == [("FAIL", "BLOCKER", "there is no table NEW_DB.SALES.parity_orders")]
    assert not [r for r in found if r.id == "M-ROW-001"]
    both = {"db.s.parity_orders": legacy, "new_db.sales.parity_orders": legacy}
    assert {r.status for r in run_parity(spark, listed, store, tables=both)} <= {"PASS", "SKIP"}
    assert clashes([Listed("a/x.twb"), Listed("b/X.twb"), Listed("c/y.twb")]) == {"x": ["a/x.twb", "b/X.twb"]}


def test_keys_and_columns_in_another_case(spark, tmp_path):
    old = spark.range(30).selectExpr("id AS K", "id % 4 AS G", "id * 1.5D AS AMT", "concat('t', id) AS Name")
    new = old.toDF("k", "g", "amt", "NAME")
    store, entry = BaselineStore(spark, str(tmp_path)), Entry("A.B.C", "D.E.F", keys=("k",), grain=("G",))
    save_snapshot(store, "o", old, entry)
    statuses = lambda target: {r.id: r.status for r in check_object(store, "o", target, entry)}
    assert set(statuses(new).values()) == {"PASS"}
    moved = statuses(new.withColumn("amt", F.when(F.col("k") == 3, 99.0).otherwise(F.col("amt"))))
    assert moved["M-HASH-001"] == moved["M-AGG-001"] == "FAIL" and moved["M-GRAIN-001"] == "PASS"
    assert statuses(new.union(new.filter("k = 4")))["M-HASH-001"] == "ERROR"
    a, b = spark.sql("SELECT 1 AS k, 2 AS v"), spark.sql("SELECT 1 AS K, 3 AS V")
    assert [r.state for r in compare_rows(a, b, ["K"]).collect()] == ["mismatch"]
    assert {(r.kind, r.col_name) for r in compare_metrics(measure(a), measure(b), ["sum", "min", "max"], 0.0).filter("breach").collect()} == {(x, "v") for x in ("sum", "min", "max")}
    assert spelled(["A", "b", "C"], ["a", "B", "c", "C"]) == ["a", "B", "C"]


def test_metrics_keep_all_digits_and_count_what_is_no_number(spark):
    old, new = (spark.sql(f"SELECT CAST({1 << 53} + {k} AS BIGINT) AS n, CAST('1.{'0' * 19}{k + 1}' AS DECIMAL(38, 20)) AS d") for k in (0, 1))
    found = compare_metrics(measure(old), measure(new), ["sum", "min", "max"], 0.0)
    assert {(r.kind, r.col_name) for r in found.filter("breach").collect()} == {(x, c) for x in ("sum", "min", "max") for c in "nd"}
    assert compare_metrics(measure(old), measure(new), ["min"], 0.01).filter("breach").count() == 0
    a, b = (spark.sql(f"SELECT CAST(x AS DOUBLE) AS v FROM VALUES ('1'), ('{x}') AS t(x)") for x in ("0", "NaN"))
    assert [r.name for r in fingerprint_breaches(fingerprint(b, irregular=True), fingerprint(a, irregular=True)).collect()] == ["nan:v"]
    assert run_checks(Context(b, baseline=a), [Spec("R-AGG-001")]).results[0].status == "FAIL"
    assert {(r.kind, r.new_value) for r in compare_metrics(measure(a), measure(b), ["nan", "inf", "-inf"], 0.0).collect()} == {("nan", 1), ("inf", 0), ("-inf", 0)}
    wide = spark.range(100).selectExpr("id AS a", "id % 7 AS b", "id % 3 AS c")
    assert {(r.col_name, r.value) for r in measure(wide, ["a", "b", "c"]).filter("kind = 'distinct'").collect()} == {("a", 100), ("b", 7), ("c", 3)}


def test_distinct_counts_share_one_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = measure(orders, ["o_orderkey", "o_custkey", "o_orderstatus"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # the key columns alone once more, however many keys there are


def test_maps_under_a_dotted_name(spark):
    a = spark.sql("SELECT map('x', 1, 'y', 2) AS `m.n`, 1 AS `k.l`")
    b = spark.sql("SELECT map('y', 2, 'x', 1) AS `m.n`, 1 AS `k.l`")
    assert row_changes(a, b).count() == 0
    assert run_checks(Context(a, baseline=b), [Spec("R-DIFF-001")]).results[0].status == "PASS"


def test_metadata_of_names_with_three_parts(spark):
    spark.sql("SELECT 1 AS i, 'x' AS s, DATE'2024-01-01' AS d").createOrReplaceTempView("meta_t")
    build = spark.range(3)
    def status(check, *queries):
        found = run_checks(Context(build, queries=queries), [Spec(check)])
        return found.results[0].status, found.verdict

    assert status("S-META-001", "SELECT i FROM no_cat.no_schema.no_table") == ("FAIL", "BLOCKED")
    assert status("S-META-001", "SELECT i FROM no_schema.no_table") == ("FAIL", "BLOCKED")
    assert status("S-META-001", "SELECT i FROM meta_t") == ("PASS", "READY")
    assert status("S-META-002", "SELECT a.i FROM meta_t a INNER JOIN no_cat.x.y b ON a.i = b.i")[0] == "WARN"
    assert status("S-META-003", "SELECT i FROM no_cat.no_schema.no_table")[0] == "PASS"
    assert mismatched_keys(spark, "SELECT 1 AS one FROM meta_t a, meta_t b WHERE a.i = b.s")
    assert mismatched_keys(spark, "SELECT 1 AS one FROM meta_t a, (SELECT d FROM meta_t WHERE i = 1) b WHERE a.i > 0 AND a.s = b.d")
    assert not mismatched_keys(spark, "SELECT 1 AS one FROM meta_t a, meta_t b WHERE a.i = b.i AND a.s = '1'")
    assert not mismatched_keys(spark, "SELECT 1 AS one FROM meta_t a WHERE a.i = a.s")
