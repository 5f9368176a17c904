"""Trees of digests beside baselines: what is read, and that nothing is missed."""

from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from buildproof.checks.registry import Context
from buildproof.checks.runner import Spec, run_checks
from buildproof.operators import hashtree
from buildproof.operators.regression import row_changes
from buildproof.plans.performance import measured
from buildproof.sources.baseline import BaselineStore


def rows(df):
    return Counter(repr((r["__change"], r["__times"], *r[2:])) for r in df.collect())


@pytest.fixture()
def store(spark, tmp_path):
    return BaselineStore(spark, str(tmp_path / "store"))


def table(spark, n=40_000):
    return spark.range(n).selectExpr("id AS k", "concat('value ', id % 977) AS `v.x`", "CAST(id AS DOUBLE) / 3 AS d", "map('a', id % 5, 'b', 1L) AS m", "if(id % 7 = 0, NULL, id) AS n")


def test_one_changed_row_reads_one_folder(spark, store):
    old = table(spark, 200_000)
    made = store.save("t", old, tree=True, keys=["k"])
    assert made["row_count"] == 200_000 and made["layout"]["depth"] == 2
    new = old.withColumn("d", F.when(F.col("k") == 12_345, -1.0).otherwise(F.col("d")))
    leaves, _, kept = store.changed_leaves("t", new)
    assert [r.keys_differ for r in leaves.collect()] == [False]
    assert measured(kept)["bytes_read"] < 0.01 * measured(store.load("t"))["bytes_read"]
    found = {(r["__change"], r["__times"], r.k, r.d) for r in store.row_changes("t", new).collect()}
    assert found == {("added", 1, 12345, -1.0), ("removed", 1, 12345, 4115.0)}
    assert store.row_changes("t", old.repartition(13)).count() == 0


@pytest.mark.parametrize("keys", [(), ("v.x", "n")])
def test_changes_are_those_of_the_whole_comparison(spark, store, keys, monkeypatch):
    monkeypatch.setattr(hashtree, "LEAF_ROWS", 16)
    monkeypatch.setattr(hashtree, "LISTED", 20)
    old = table(spark, 3000).union(table(spark, 40)).union(table(spark, 3).limit(1))
    store.save("t", old, tree=True, keys=keys)
    for new in (
        old.filter("k <> 77").union(old.filter("k = 9")).withColumn("n", F.when(F.col("k") == 7, 0).otherwise(F.col("n"))),  # a row less, one more of those that are there, a null that became a value
        old.withColumn("k", F.when(F.col("k") < 100, F.col("k") + 10_000).otherwise(F.col("k"))),  # more than can be listed
        old.toDF(*[c.upper() for c in old.columns]),
        old.limit(0),
    ):
        want = rows(row_changes(new, old))
        assert rows(store.row_changes("t", new)) == want


def test_columns_that_cannot_be_compared_by_hash_are_compared_whole(spark, store):
    store.save("t", spark.range(5).selectExpr("id AS k", "1 AS v"), tree=True)
    as_double = spark.range(5).selectExpr("id AS k", "1.0D AS v")
    assert store.changed_leaves("t", as_double) is None and store.row_changes("t", as_double).count() == 0
    assert store.row_changes("t", as_double.drop("v").filter("k > 0")).count() == 1
    store.save("plain", spark.range(3))
    assert store.layout("plain") is None and store.row_changes("plain", spark.range(4)).count() == 1


def test_no_numbers_and_signs_of_zero(spark, store):
    numbers = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("CAST(t AS DOUBLE) AS d")
    store.save("t", numbers("NaN", "0.0", "inf"), tree=True)
    assert store.row_changes("t", numbers("-0.0", "inf", "NaN")).count() == 0
    assert store.row_changes("t", numbers("0.0", "NaN", "NaN")).count() == 2


def test_the_check_goes_by_the_tree(spark, store):
    old = table(spark, 3000).drop("m")
    store.save("t", old, tree=True, keys=["k"])
    
    def status(new):
        return run_checks(Context(new, baseline=store.load("t"), kept=(store, "t")), [Spec("R-DIFF-001")]).results[0]

    assert status(old).status == "PASS"
    found = status(old.filter("k <> 5"))
    assert found.status == "FAIL" and found.observed.startswith("1 ") and found.sample[0]["k"] == 5


def test_versions_stay_for_those_who_read_them(spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "s"))
    store.save("b", spark.range(5))
    loaded = store.load("b")
    store.save("b", spark.range(7))
    assert loaded.count() == 5 and store.load("b").count() == 7
    unfinished = tmp_path / "s" / "b" / "v20990101T000000000000-00000000" / "rows"
    unfinished.mkdir(parents=True)
    brief = BaselineStore(spark, str(tmp_path / "s"), keep_for=timedelta(0))
    brief.save("b", spark.range(9))
    assert brief.load("b").count() == 9 and unfinished.exists() and len(list((tmp_path / "s" / "b").iterdir())) == 2
