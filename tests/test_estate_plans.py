"""Lineage through many scripts, and joins that multiply rows."""

import random

from buildproof.checks.registry import Context
from buildproof.checks.runner import Spec, run_checks
from buildproof.plans.estate_lineage import dependents, script_edges, sources
from buildproof.plans.fanout import joins
from buildproof.plans.performance import measured


def test_all_that_depends_on_a_column_over_200_scripts(spark):
    """Every script makes a view of two earlier ones or of base tables; the plain twin follows single columns."""
    rnd = random.Random(3)
    scripts, links = {}, []  # links: (table, column) -> (table, column)
    names = [f"base{k}" for k in range(5)]
    for n in range(200):
        a, b = rnd.choice(names), rnd.choice(names)
        x, y, z = (rnd.choice("pqr") for _ in range(3))
        if n % 10 == 3:
            scripts[f"s{n}.sql"] = f"CREATE VIEW v{n} AS SELECT * FROM {a}"
            links += [((a, c), (f"v{n}", c)) for c in "pqr"]
        elif n % 10 == 5:
            scripts[f"s{n}.sql"] = f"-- two steps\nCREATE TABLE v{n} AS WITH w AS (SELECT {x} AS m, {y} FROM {a}) SELECT w.m AS p, w.{y} AS r FROM w"
            links += [((a, x), (f"v{n}", "p")), ((a, y), (f"v{n}", "r"))]
        else:
            scripts[f"s{n}.sql"] = f"CREATE OR REPLACE VIEW v{n} AS SELECT l.{x} AS p, l.{y} + 1 AS q, r.{z} AS r FROM {a} l INNER JOIN {b} r ON l.p = r.p"
            links += [((a, x), (f"v{n}", "p")), ((a, y), (f"v{n}", "q")), ((b, z), (f"v{n}", "r"))]
        names.append(f"v{n}")
    scripts["last.sql"] = "SELECT p AS shown FROM v199"
    edges = script_edges(spark, scripts).cache()

    def plain(start):
        seen, todo = set(), [start]
        while todo:
            now = todo.pop()
            for a, b in links:
                if a == now and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    views = lambda rows: {(r.node[6:], r.col) for r in rows if r.node.startswith("table:")}
    for start in (("base0", "p"), ("base3", "q"), next(a for a, _ in links if a[0].startswith("v"))):
        assert views(dependents(edges, *start).collect()) == plain(start) and plain(start)
    every = sources(edges, ["base1"]).collect()
    for c in "pqr":
        assert views([r for r in every if r.origin == f"base1.{c}"]) == plain(("base1", c))
    assert {r.node for r in dependents(edges, "v199", "p").collect()} == {"script:last.sql"}


def test_lineage_of_cycles_and_nothing(spark):
    edges = script_edges(spark, {"a": "CREATE VIEW x AS SELECT k FROM y", "b": "CREATE VIEW y AS SELECT k FROM x", "c": "DROP TABLE z"})
    assert {(r.node, r.col) for r in dependents(edges, "x", "K").collect()} == {("table:y", "k")}
    assert dependents(edges, "none", "k").count() == 0 and script_edges(spark, {}).count() == 0


def test_the_join_and_the_key_that_multiply_rows(spark):
    spark.range(1000).selectExpr("id AS k", "id % 10 AS g").createOrReplaceTempView("fan_a")
    spark.range(3000).selectExpr("if(id < 2000, 7L, id % 10) AS g", "id AS v").createOrReplaceTempView("fan_b")
    spark.range(1000).selectExpr("id AS k", "id AS w").createOrReplaceTempView("fan_c")
    build = spark.sql("SELECT /*+ MERGE(b) */ a.k, b.v, c.w FROM fan_a a INNER JOIN fan_b b ON a.g = b.g INNER JOIN fan_c c ON a.k = c.k")
    assert measured(build)["most_rows"] == 300_000
    first, second = joins(build)
    assert first.out == 300_000 and {first.left, first.right} == {1000, 3000} and second.growth == 1.0
    assert first.times == 100 and first.key in set("0123456789")  # each key has as many rows on the smaller side
    found = run_checks(Context(build), [Spec("P-CARD-001")]).results[0]
    assert found.status == "WARN" and "1000 and 3000 rows gave 300000" in found.observed or "3000 and 1000" in found.observed
    fine = spark.sql("SELECT a.k, c.w FROM fan_a a INNER JOIN fan_c c ON a.k = c.k")
    assert run_checks(Context(fine), [Spec("P-CARD-001")]).results[0].status == "PASS"
    skewed = spark.sql("SELECT b.v, a.k FROM fan_b b INNER JOIN (SELECT if(id < 380, 7L, id) AS g, id AS k FROM range(400)) a ON a.g = b.g")
    measured(skewed)
    worst = joins(skewed)[0]
    assert worst.out == 380 * 2100 and worst.key == "7" and worst.times == 380
