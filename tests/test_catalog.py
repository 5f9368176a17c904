"""References of queries against the catalog as a table."""

import pytest

from buildproof.checks.registry import Context
from buildproof.checks.runner import Spec, run_checks
from buildproof.sources.catalog import columns, of_queries, references, tables


@pytest.fixture(scope="module")
def schema(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS cat_demo")
    spark.sql("CREATE TABLE IF NOT EXISTS cat_demo.orders (k INT, v STRING) USING parquet COMMENT 'Deprecated: use sales'")
    spark.sql("CREATE TABLE IF NOT EXISTS cat_demo.sales (k INT) USING parquet")
    spark.range(3).createOrReplaceTempView("cat_view")
    yield
    spark.sql("DROP SCHEMA cat_demo CASCADE")


def test_names_of_one_two_and_three_parts(spark, schema):
    queries = ["WITH w AS (SELECT k FROM cat_demo.ORDERS) SELECT w.k FROM w INNER JOIN spark_catalog.cat_demo.sales s ON w.k = s.k", "SELECT id FROM cat_view", "SELECT a FROM other.s.t INNER JOIN cat_demo.gone g ON t.a = g.a"]
    found = {(r.query, r.reference): (r.kind, r.comment) for r in of_queries(spark, queries).collect()}
    assert found == {
        (0, "cat_demo.ORDERS"): ("managed", "Deprecated: use sales"),
        (0, "spark_catalog.cat_demo.sales"): ("managed", None),
        (1, "cat_view"): ("view", None),
        (2, "other.s.t"): (None, None),
        (2, "cat_demo.gone"): (None, None),
    }
    assert references(spark, []).count() == 0 and of_queries(spark, []).count() == 0
    every = tables(spark)
    assert {("cat_demo", "orders"), ("cat_demo", "sales"), (None, "cat_view")} <= {(r.schema, r.name) for r in every.collect()}
    assert {(r.column, r.type, r.place) for r in columns(spark, every.filter("name = 'orders'")).collect()} == {("k", "int", 0), ("v", "string", 1)}


def test_metadata_checks_go_by_the_table(spark, schema):
    def status(check, query):
        return run_checks(Context(spark.range(1), queries=(query,)), [Spec(check)]).results[0]

    assert status("S-META-001", "SELECT k FROM spark_catalog.cat_demo.orders").status == "PASS"
    lost = status("S-META-001", "SELECT k FROM spark_catalog.cat_demo.gone")
    assert (lost.status, lost.observed) == ("FAIL", "spark_catalog.cat_demo.gone")
    old = status("S-META-003", "SELECT k FROM cat_demo.orders")
    assert (old.status, old.observed) == ("FAIL", "cat_demo.orders") and status("S-META-003", "SELECT k FROM cat_demo.sales").status == "PASS"
