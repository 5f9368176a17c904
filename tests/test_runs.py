"""Rulesets, parity and estate runs, lineage, limits, the run log, and what a stopped or nested case must not do."""

import json

import pytest
from pyspark.sql import functions as F

from buildproof.checks import audit, ruleset
from buildproof.checks.estate import Listed, estate_of, run_estate, run_parity
from buildproof.checks.limits import TimedOut, limited, read_capped
from buildproof.checks.registry import Context
from buildproof.checks.report import estate_as_html, estate_as_json, estate_as_junit
from buildproof.checks.runner import Spec, run_checks
from buildproof.functions.pii import HIDDEN, safe_sample
from buildproof.operators.parity import compare_rows, grain_groups
from buildproof.plans.lineage import lineage, projected_columns
from buildproof.sources.baseline import BaselineStore, open_store
from buildproof.sources.mapping import Entry, resolve_post_swap


def test_a_save_that_breaks_off_keeps_the_baseline(spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "s"))
    store.save("b", spark.range(5))
    with pytest.raises(Exception):
        store.save("b", spark.range(9).select(F.raise_error(F.lit("stopped")).alias("id")))
    assert store.load("b").count() == 5 and store.manifest("b")["row_count"] == 5
    (tmp_path / "s" / "b" / "v9-rows-only" / "rows").mkdir(parents=True)  # stopped before its manifest
    assert store.load("b").count() == 5 and store.list_names() == ["b"]
    store.save("b", spark.range(7))
    store.save("c", spark.range(2))
    assert {r.name: r.row_count for r in open_store(spark, {"root": str(tmp_path / "s")}).index().collect()} == {"b": 7, "c": 2}
    with pytest.raises(KeyError):
        store.load("none")


def test_personal_data_in_nested_columns_is_hidden(spark):
    kind = "a array<string>, s struct<email:string, deep:array<struct<t:string>>>, m map<string,string>, driver_license string, n long"
    row = (["x a.b@c.org", None], ("q", [("me@site.org",)]), {"k@site.org": "078-05-1120"}, "D1", 5)
    got = safe_sample(spark.createDataFrame([row], kind), 3).first()
    assert got.a == ["x " + HIDDEN, None] and got.s.email == HIDDEN and got.s.deep[0].t == HIDDEN and got.driver_license == HIDDEN and got.n == 5
    assert [tuple(e) for e in got.m] == [(HIDDEN, HIDDEN)]


def test_rows_of_repeated_keys_make_no_pairs(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (3, "y"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (4, "y"), (None, "n")], "k int, v string")
    assert {tuple(r) for r in compare_rows(old, new, ["k"]).collect()} == {("1", "missing"), ("2", "mismatch"), ("3", "missing"), ("4", "extra")}
    marks = grain_groups(spark.createDataFrame([(None,), ("∅",), ("∅∅",)], "g string"), ["g"])
    assert sorted(r.g for r in marks.collect()) == ["∅", "∅∅", "∅∅∅"]


def test_defaults_and_dotted_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`a.b` int, c string").withColumn("ts", F.lit("2024-01-02 00:00:00"))
    specs = [Spec("D-NULL-002", {"columns": ["c"]}), Spec("D-FRESH-001", {"event_ts_col": "ts"}), Spec("D-GRAIN-001", {"key": ["a.b"]}), Spec("D-NULL-001", {"key": ["a.b"]})]
    assert [r.status for r in run_checks(Context(df, as_of="2024-01-02 23:00:00"), specs).results] == ["FAIL", "PASS", "PASS", "PASS"]
    assert run_checks(Context(df, as_of="2024-01-03 01:00:00"), specs[1:2]).results[0].status == "FAIL"
    many = spark.range(100).select((F.col("id") % 30).alias("k"))
    found = run_checks(Context(many, evidence_rows=4), [Spec("D-GRAIN-001", {"key": ["k"]})]).results[0]
    assert found.observed.startswith("30 ") and len(found.sample) == 4 and found.sample[0]["dup_count"] == 4


RULES = """
version: "2024.1"
defaults: {fail_on: READY_WITH_NOTES, evidence_sample_rows: 3}
deprecated_objects: [OLD.T]
severity_overrides: {D-NULL-002: HIGH}
thresholds: {null_rate_default: 0.5}
checks:
  - id: D-NULL-002
    params: {columns: [c]}
  - id: S-STAT-007
"""


def test_rulesets_and_profiles(spark, tmp_path):
    (tmp_path / "r.yml").write_text(RULES)
    rules = ruleset.load(tmp_path / "r.yml", pin="2024.1")
    nulls, old = rules.specs()
    assert (nulls.severity, nulls.params["threshold"]) == ("HIGH", 0.5) and old.params["deprecated"] == ("OLD.T",)
    assert rules.fails("READY_WITH_NOTES") and not rules.fails("READY")
    laid = ruleset.overlaid(rules, {"name": "p", "thresholds": {"null_rate_default": 0.1}, "deprecated_objects": ["OLD.U", "OLD.T"], "checks": [{"id": "D-NULL-002", "enabled": False}, {"id": "D-DUP-001"}]})
    assert [(s.id, s.enabled) for s in laid.specs()] == [("D-NULL-002", False), ("S-STAT-007", True), ("D-DUP-001", True)]
    assert laid.deprecated_objects == ("OLD.T", "OLD.U") and laid.thresholds["null_rate_default"] == 0.1 and laid.defaults.evidence_sample_rows == 3
    with pytest.raises(ValueError, match="pinned"):
        ruleset.load(tmp_path / "r.yml", pin="2023.9")
    for wrong in ({"version": "1", "chekcs": []}, {"version": "a b"}, {"version": "1", "severity_overrides": {"X": "BAD"}}, {"version": "1", "pii_column_patterns": ["("]}, {"version": "1", "defaults": {"fail_on": "READY"}}):
        with pytest.raises(ValueError):
            ruleset.make(wrong)
    build = spark.createDataFrame([(None,), ("x",), ("y",)], "c string")
    run = run_checks(Context(build, queries=("SELECT a FROM OLD.T",)), rules.specs())
    assert [r.status for r in run.results] == ["PASS", "FAIL"]


def test_lineage_shows_joins_columns_and_risks(spark):
    found = lineage(spark, "WITH cust AS (SELECT id, region FROM raw.customers WHERE region <> 'x' AND id > 3), ord AS (SELECT id, cust_id, amount FROM raw.orders) SELECT c.region, SUM(o.amount) AS total FROM ord o LEFT JOIN cust c ON o.cust_id = c.id GROUP BY c.region")
    edges = {(e.source, e.target): e for e in found.edges}
    assert set(found.nodes) == {"output", "cte:cust", "cte:ord", "table:raw.customers", "table:raw.orders"} and not found.risks
    joined = edges["cte:cust", "output"]
    assert joined.relation == "left join" and "cust_id" in joined.on and ("region", "region") in joined.links and ("amount", "total") in edges["cte:ord", "output"].links
    assert len(found.nodes["cte:cust"].filters) == 2 and found.nodes["output"].calculations and found.nodes["output"].columns == ["region", "total"]
    assert edges["table:raw.orders", "cte:ord"].relation == "from"
    assert len(lineage(spark, "SELECT a FROM t, u").risks) == 1 and len(lineage(spark, "SELECT a FROM t CROSS JOIN u").risks) == 1
    assert not lineage(spark, "SELECT a FROM t JOIN u USING (id)").risks
    nested = lineage(spark, "SELECT x.a FROM (SELECT a FROM t UNION ALL SELECT b FROM u) x WHERE x.a IN (SELECT k FROM v)")
    assert {"table:t", "table:u", "table:v", "subquery:x"} <= set(nested.nodes) and any(e.relation == "subquery" for e in nested.edges)


def test_projected_columns_of_custom_queries(spark):
    told = lambda sql: projected_columns(spark, sql)
    assert told("SELECT a, t.b, c + 1 AS d FROM t") == ["A", "B", "D"]
    assert told("SELECT a, SUM(b) AS s, SUM(b) + 1 AS s1, row_number() OVER (ORDER BY a) AS n FROM t GROUP BY a") == ["A"]
    assert told("SELECT COUNT(*) AS n FROM t") == [] and told("SELECT a, b AS a, c FROM t") == ["C"]
    assert told("WITH x AS (SELECT * FROM t) SELECT a FROM x UNION SELECT q FROM y") == ["A"]
    for lost in ("SELECT * FROM t", "SELECT t.* FROM t", "SELECT a + 1 FROM t", "DELETE FROM t", "SELECT 1; SELECT 2", "no sql"):
        assert told(lost) is None, lost


def test_limits(spark):
    assert read_capped(spark.range(5), 5)[1] is False and read_capped(spark.range(6), 5)[1] is True and len(read_capped(spark.range(6), 5)[0]) == 5
    with pytest.raises(TimedOut):
        with limited(spark, "slow", 1.0):
            spark.sparkContext.parallelize(range(8), 8).map(lambda x: __import__("time").sleep(20)).count()
    with limited(spark, "quick", 60):
        assert spark.range(3).count() == 3


def _workbook(path, tables):
    sources = "".join(f"<datasource name='d{k}' caption='D{k}'><connection class='federated'><named-connections><named-connection><connection class='snowflake' dbname='DB' schema='S'/></named-connection></named-connections><relation type='table' table='[{t}]'/></connection></datasource>" for k, t in enumerate(tables))
    path.write_text(f"<workbook><datasources>{sources}</datasources></workbook>")


def test_estate_runs_both_phases(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "id % 3 AS g", "id * 2.5 AS v").createOrReplaceTempView("estate_old")
    spark.table("estate_old").createOrReplaceTempView("estate_new")
    spark.table("estate_old").filter("k <> 7").createOrReplaceTempView("estate_bad")
    _workbook(tmp_path / "good.twb", ["estate_old"])
    _workbook(tmp_path / "bad.twb", ["estate_old"])
    _workbook(tmp_path / "gone.twb", ["nowhere"])
    for name, new in (("good", "estate_new"), ("bad", "estate_bad")):
        (tmp_path / f"{name}.yml").write_text(f"version: 1\nobjects:\n  - {{old: DB.S.estate_old, new: N.S.{new}, keys: [k], grain: [g]}}\n")
    (tmp_path / "estate.yml").write_text("version: 1\nworkbooks:\n  - {path: good.twb, map: good.yml}\n  - {path: bad.twb, map: bad.yml}\n  - {path: gone.twb}\n")
    store, listed = BaselineStore(spark, str(tmp_path / "store")), estate_of(str(tmp_path / "estate.yml"))
    tables = {"DB.S.ESTATE_OLD": spark.table("estate_old"), "n.s.estate_new": spark.table("estate_new"), "N.S.estate_bad": spark.table("estate_bad"), "DB.S.estate_new": spark.table("estate_new")}
    estate = run_estate(spark, listed, store, tables=tables)
    verdicts = {w.path.rsplit("/", 1)[-1]: estate.verdict_of(w.path) for w in estate.workbooks}
    assert verdicts == {"good.twb": "READY", "bad.twb": "BLOCKED", "gone.twb": "BLOCKED"} and estate.verdict == "BLOCKED" and len(estate.errors) == 1
    assert json.loads(estate_as_json(estate))["verdict"] == "BLOCKED" and "M-ROW-001" in estate_as_junit(estate) and "good.twb" in estate_as_html(estate)
    missing = run_parity(spark, Listed(str(tmp_path / "good.twb"), str(tmp_path / "good.yml"), "other"), store, "check", tables=tables)
    assert {r.id: r.status for r in missing}["M-SNAP-001"] == "FAIL"
    (tmp_path / "swapped").mkdir()
    _workbook(tmp_path / "swapped" / "good.twb", ["estate_new"])
    (tmp_path / "good.yml").write_text("version: 1\nobjects:\n  - {old: DB.S.estate_old, new: DB.S.estate_new, keys: [k], grain: [g]}\n")
    after = run_parity(spark, Listed(str(tmp_path / "swapped" / "good.twb"), str(tmp_path / "good.yml")), store, "check", swapped=True, tables=tables)
    assert {r.status for r in after} == {"PASS"} and any(r.id == "M-HASH-001" for r in after)


def test_manifests(tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        _workbook(tmp_path / folder / "same.twb", [])
    assert len(estate_of(str(tmp_path / "a" / "*.twb"), "m.yml")) == 1
    with pytest.raises(ValueError, match="share"):
        estate_of(str(tmp_path / "*" / "*.twb"))
    with pytest.raises(ValueError, match="no workbook"):
        estate_of(str(tmp_path / "none" / "*.twb"))
    (tmp_path / "m.yml").write_text("version: 1\nworkbooks: [{path: a/same.twb}, {path: b/same.twb, snapshot_prefix: other}]")
    assert [w.prefix for w in estate_of(str(tmp_path / "m.yml"))] == ["same", "other"]
    (tmp_path / "m.yml").write_text("version: 1\nworkbooks: [{path: a/same.twb, snapshot_prefix: ../x}]")
    with pytest.raises(ValueError):
        estate_of(str(tmp_path / "m.yml"))


def test_names_after_the_swap():
    entries = [Entry("A.S.T", "N.S.T"), Entry("S.U", "N.S.U"), Entry("A.S.V", "M.S.W"), Entry("A.S.X", "N.S.W")]
    found = resolve_post_swap(["N.S.T", "S.T", "N.S.U", "S.W", "N.S.Q", "TMP.S.Z"], entries, ["TMP.*"])
    assert {k: e.old for k, e in found.resolved.items()} == {"N.S.T": "A.S.T", "S.T": "A.S.T"}
    assert len(found.uninvertible) == 2 and found.unmapped == ["N.S.Q"] and found.ignored == ["TMP.S.Z"]
    with pytest.raises(ValueError):
        resolve_post_swap([], [Entry("A.S.T", "N.S.T"), Entry("A.S.U", "N.S.T")])


def test_run_log(spark, tmp_path):
    log = tmp_path / "log" / "runs.jsonl"
    for k, rows in enumerate((3, 3, 0)):
        run = run_checks(Context(spark.range(rows)), [Spec("D-GRAIN-002", {"min_rows": 1})])
        audit.append(log, audit.record(run, "t", f"run {k}", user="me"))
    runs = audit.history(spark, str(log))
    assert [(r.n, r.verdict, r.changed) for r in audit.trend(runs, 2).orderBy("n").collect()] == [(1, "REVIEW", True), (2, "READY", False)]
    first = audit.page(runs, 2).collect()
    assert [r.source for r in first] == ["run 2", "run 1"]
    assert [r.source for r in audit.page(runs, 2, (first[-1].at, first[-1].run_id)).collect()] == ["run 0"]


def test_command_line(spark, tmp_path, capsys):
    from buildproof.cli import doctor, main

    spark.range(4).selectExpr("id AS c").write.parquet(str(tmp_path / "t"))
    (tmp_path / "b.sql").write_text("SELECT c FROM t")
    (tmp_path / "r.yml").write_text(RULES)
    code = main(["--table", f"t={tmp_path / 't'}", "--store", str(tmp_path / "s"), "check", str(tmp_path / "b.sql"), "--ruleset", str(tmp_path / "r.yml"), "--audit", str(tmp_path / "a.jsonl")])
    assert code == 0 and json.loads(capsys.readouterr().out)["verdict"] == "READY" and (tmp_path / "a.jsonl").read_text().count("\n") == 1
    assert main(["lineage", str(tmp_path / "b.sql")]) == 0 and "table:t" in capsys.readouterr().out
    assert main(["history", str(tmp_path / "a.jsonl")]) == 0 and "READY" in capsys.readouterr().out
    assert all(ok for _, ok, _ in doctor())
