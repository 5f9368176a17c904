import pytest
from pyspark.sql import functions as F

from buildproof.checks.migration import Workbook, check_estate, check_map, check_object, check_snapshots, check_sources, save_snapshot, snapshot_name
from buildproof.checks.verdict import Result
from buildproof.sources.baseline import BaselineStore
from buildproof.sources.mapping import Entry, Resolution

ENTRY = Entry("DB.S.ORDERS", "NEW.S.ORDERS", keys=("o_orderkey",), grain=("o_orderstatus",), columns={"o_orderpriority": "priority_cd"})


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@pytest.fixture(scope="module")
def store(spark, orders, tmp_path_factory):
    made = BaselineStore(spark, str(tmp_path_factory.mktemp("snapshots")))
    save_snapshot(made, "orders", orders, ENTRY)
    return made


def statuses(store, target):
    return {r.id[2:-4]: r.status for r in check_object(store, "orders", target, ENTRY)}


def test_same_object_passes(store, orders):
    moved = orders.withColumnRenamed("o_orderpriority", "priority_cd").withColumn("o_custkey", F.col("o_custkey").cast("decimal(20,0)")).withColumn("more", F.lit(1))
    assert set(statuses(store, moved).values()) == {"PASS"}


def test_each_drift_is_seen(store, orders):
    moved = orders.withColumnRenamed("o_orderpriority", "priority_cd")
    assert statuses(store, moved.filter("o_orderkey <> 7"))["ROW"] == "FAIL"
    scaled = statuses(store, moved.withColumn("o_totalprice", F.col("o_totalprice") * 1.5))
    assert scaled["AGG"] == "FAIL" and scaled["HASH"] == "FAIL" and scaled["ROW"] == "PASS"
    emptied = statuses(store, moved.withColumn("priority_cd", F.when(F.col("o_orderkey") % 5 > 0, F.col("priority_cd"))))
    assert emptied["NULL"] == "FAIL" and emptied["AGG"] == "PASS"
    swapped = statuses(store, moved.withColumn("priority_cd", F.when(F.col("o_orderkey") == 3, "other").otherwise(F.col("priority_cd"))))
    assert [k for k, v in swapped.items() if v == "FAIL"] == ["HASH"]
    regrouped = statuses(store, moved.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))))
    assert regrouped["GRAIN"] == "FAIL"
    retyped = statuses(store, moved.withColumn("o_custkey", F.col("o_custkey").cast("string")))
    assert retyped["SCHEMA"] == "FAIL"
    dropped = statuses(store, moved.drop("o_totalprice"))
    assert dropped["SCHEMA"] == "FAIL" and dropped["HASH"] == "WARN"
    assert statuses(store, moved.union(moved.limit(1)))["HASH"] == "ERROR"


def test_schema_losses_count_the_values_at_stake(orders):
    from buildproof.operators.parity import schema_losses

    moved = orders.drop("o_totalprice").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("more", F.lit(1))
    some = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")))
    n, even = orders.count(), orders.filter("o_orderkey % 2 = 0").count()
    assert sorted(map(tuple, schema_losses(some, moved).collect())) == [("o_custkey", "numeric became text", n), ("o_totalprice", "missing", even)]
    assert schema_losses(orders, orders.withColumn("more", F.lit(1))).count() == 0
    assert schema_losses(orders.limit(0), moved).filter("n_values = 0").count() == 2


def test_preparations(spark, store, orders):
    assert check_snapshots(store, ["orders"]).status == "PASS" and check_snapshots(store, ["orders", "none"]).status == "FAIL"
    assert check_map(Resolution({}, ["x"], [])).status == "FAIL" and check_map(Resolution({}, [], ["y"])).status == "PASS"
    relations = lambda *kinds: spark.createDataFrame([("p", f"d{i}", k, "why", False) for i, k in enumerate(kinds)], "path string, datasource string, kind string, detail string, has_extract boolean")
    assert [r.status for r in check_sources(relations("table", "refused"))] == ["WARN", "SKIP"]
    assert check_sources(relations("refused"))[0].status == "FAIL" and check_sources(relations("table"))[0].status == "PASS"
    assert snapshot_name("a b", "c", "d") != snapshot_name("a_b", "c", "d")
    with pytest.raises(ValueError):
        save_snapshot(store, "bad", orders, Entry("a.b", "c.d", keys=("none",)))


def test_estate_rolls_up():
    made = lambda severity, status: [Result("x", "x", "migration_parity", severity, status)]
    results, overall = check_estate([Workbook("a", made("LOW", "PASS")), Workbook("b", made("HIGH", "FAIL"))])
    assert [r.status for r in results] == ["PASS", "FAIL"] and overall == "REVIEW"
    results, overall = check_estate([Workbook("a", None)])
    assert results[0].status == "FAIL" and overall == "BLOCKED"
    results, overall = check_estate([])
    assert [r.status for r in results] == ["WARN", "SKIP"] and overall is None
