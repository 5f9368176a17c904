import itertools
import json
import xml.etree.ElementTree as ET

import pytest

from buildproof.checks.registry import Context
from buildproof.checks.report import as_html, as_json, as_junit
from buildproof.checks.runner import Spec, run_checks
from buildproof.checks.verdict import SEVERITIES, STATUSES, VERDICTS, Result, coverage, roll_up, verdict, worst


def made(severity, status):
    return Result("X", "x", "assertions", severity, status)


def test_verdict_is_monotone_and_agrees_with_the_aggregate(spark):
    kinds = list(itertools.product(SEVERITIES, STATUSES))
    cases = [(k, [a, b]) for k, (a, b) in enumerate(itertools.product(kinds, kinds))]
    rows = [(k, s, t) for k, pair in cases for s, t in pair]
    got = {r.k: r.verdict for r in roll_up(spark.createDataFrame(rows, "k int, severity string, status string"), "k").collect()}
    for k, pair in cases:
        both = verdict([made(*p) for p in pair])
        assert got[k] == both
        assert VERDICTS.index(both) == min(VERDICTS.index(verdict([made(*p)])) for p in pair)
    assert verdict([]) == "READY" and worst([]) is None and worst(["READY", None]) == "BLOCKED"


@pytest.fixture()
def build(spark):
    rows = [(1, "a", 5.0, "x"), (1, "a", -1.0, "  "), (2, None, 7.0, "me@site.org"), (3, "zz", None, "y")]
    return spark.createDataFrame(rows, "id int, code string, amount double, note string")


def statuses(run):
    return {r.id: r.status for r in run.results}


def test_checks_decide(spark, build):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    specs = [
        Spec("D-GRAIN-001", {"key": ["id"]}),
        Spec("D-GRAIN-002", {"min_rows": 4, "max_rows": 4}),
        Spec("D-NULL-001", {"key": ["id", "code"]}),
        Spec("D-NULL-002", {"columns": ["code"], "threshold": 0.25}),
        Spec("D-BLANK-001", {"columns": ["note"]}),
        Spec("D-POS-001", {"columns": ["amount"]}),
        Spec("D-DISTINCT-001", {"column": "code", "min": 2, "max": 2}),
        Spec("D-RI-001", {"fk_column": "id", "ref_table": "parent", "ref_column": "k"}),
        Spec("D-DOMAIN-001", {"column": "code", "allowed": ["a", "zz", 7]}),
        Spec("D-RANGE-001", {"column": "amount", "min": -1, "max": 7}),
        Spec("D-DUP-001"),
        Spec("D-CUSTOM-001", {"name": "mine", "sql": "SELECT * FROM {{ target }} WHERE id = 3", "severity": "LOW"}),
        Spec("D-RECON-001", {"metric_sql": "SELECT 10", "source_of_truth_sql": "SELECT 11", "tolerance_pct": 0.1}),
        Spec("R-DIFF-001"),
        Spec("D-NULL-001", {"key": ["nope"]}),
        Spec("NO-SUCH"),
        Spec("D-CUSTOM-001", {"name": "bad", "sql": "DROP TABLE x"}),
    ]
    run = run_checks(Context(build, tables={"parent": parent}), specs)
    got = [r.status for r in run.results]
    assert got == ["FAIL", "PASS", "FAIL", "PASS", "FAIL", "FAIL", "PASS", "FAIL", "PASS", "PASS", "PASS", "FAIL", "PASS", "SKIP", "SKIP", "SKIP", "ERROR"]
    assert run.verdict == "BLOCKED" and run.results[11].id == "D-CUSTOM:mine" and run.results[11].severity == "LOW"
    assert json.loads(as_json(run))["verdict"] == "BLOCKED" and "BLOCKED" in as_html(run)
    suite = ET.fromstring(as_junit(run))
    assert suite.get("failures") == "6" and suite.get("errors") == "1" and suite.get("skipped") == "3"


def test_baseline_checks_and_hidden_evidence(build):
    same = run_checks(Context(build, baseline=build), [Spec("R-DIFF-001"), Spec("R-AGG-001")])
    assert statuses(same) == {"R-DIFF-001": "PASS", "R-AGG-001": "PASS"} and same.verdict == "READY"
    other = build.filter("id <> 2")
    run = run_checks(Context(other, baseline=build), [Spec("R-DIFF-001"), Spec("R-AGG-001")])
    assert set(statuses(run).values()) == {"FAIL"} and run.verdict == "REVIEW"
    assert "me@site.org" not in json.dumps(run.results[0].sample) and run.results[0].sample


def test_one_bad_metric_fails_alone(build):
    run = run_checks(Context(build), [Spec("D-POS-001", {"columns": ["code"]}), Spec("D-GRAIN-002", {"min_rows": 1})])
    assert [r.status for r in run.results] == ["ERROR", "PASS"]


def test_freshness_and_empty_build(spark):
    events = spark.createDataFrame([("2024-01-31 20:00:00",)], "t string").selectExpr("cast(t as timestamp_ntz) AS t")
    fresh = Spec("D-FRESH-001", {"event_ts_col": "t", "sla_hours": 4})
    assert statuses(run_checks(Context(events, as_of="2024-02-01 00:00:00"), [fresh])) == {"D-FRESH-001": "PASS"}
    assert statuses(run_checks(Context(events, as_of="2024-02-01 00:00:01"), [fresh])) == {"D-FRESH-001": "FAIL"}
    empty = run_checks(Context(events.limit(0), as_of="2024-02-01 00:00:00"), [fresh, Spec("D-NULL-002", {"columns": ["t"]}), Spec("D-NULL-001", {"key": ["t"]})])
    assert [r.status for r in empty.results] == ["WARN", "WARN", "PASS"]


def test_coverage_names_what_was_left_out():
    found = coverage([made("HIGH", "PASS")], ("assertions", "regression"))
    assert found == {"ran": ["assertions"], "left_out": ["regression"], "skipped_checks": []}


def test_diff_fails_on_columns_that_differ(build):
    def diff(now, before):
        return run_checks(Context(now, baseline=before), [Spec("R-DIFF-001")]).results[0]

    dropped, more = diff(build.drop("note"), build), diff(build.selectExpr("*", "1 AS extra"), build)
    assert (dropped.status, dropped.observed) == ("FAIL", "columns removed: NOTE")
    assert (more.status, more.observed) == ("FAIL", "columns added: EXTRA")
    as_text = diff(build.selectExpr("CAST(id AS STRING) AS id", "code", "amount", "note"), build)
    assert (as_text.status, as_text.observed) == ("FAIL", "columns numeric on one side only: ID")
    assert diff(build.withColumnRenamed("id", "ID"), build).status == "PASS"
    changed = diff(build.selectExpr("id + 1 AS ID", "code", "amount", "note"), build)
    assert changed.status == "FAIL" and changed.sample


def test_findings_on_texts_plans_and_migrations_count(spark, build, tmp_path):
    from buildproof.checks.migration import save_snapshot
    from buildproof.sources.baseline import BaselineStore
    from buildproof.sources.mapping import Entry

    build.createOrReplaceTempView("checked")
    bad = run_checks(Context(build, queries=("SELECT a.id FROM checked a INNER JOIN checked b",)), [Spec("S-STAT-002")])
    assert bad.verdict == "BLOCKED" and (bad.results[0].severity, bad.results[0].status) == ("BLOCKER", "FAIL")
    lost = run_checks(Context(build, queries=("SELECT id FROM no_such_table",)), [Spec("S-META-001"), Spec("S-STAT-002"), Spec("D-ADD-001")])
    assert [r.status for r in lost.results] == ["FAIL", "PASS", "PASS"] and lost.results[0].observed == "no_such_table"
    keys = run_checks(Context(build, queries=("SELECT a.id FROM checked a INNER JOIN checked b ON a.id = b.code",)), [Spec("S-META-002")])
    assert keys.verdict == "REVIEW"
    store = BaselineStore(spark, str(tmp_path))
    entry = Entry("A.B.C", "D.E.F", keys=("note",))
    save_snapshot(store, "old", build, entry)
    specs = [Spec(f"M-{x}-001") for x in ("SNAP", "SCHEMA", "ROW", "AGG", "NULL", "DIST", "HASH")]
    assert {r.status for r in run_checks(Context(build, migrated=(store, "old", build, entry)), specs).results} == {"PASS"}
    fewer = run_checks(Context(build, migrated=(store, "old", build.filter("id <> 3"), entry)), specs)
    assert fewer.verdict == "BLOCKED" and statuses(fewer)["M-ROW-001"] == "FAIL" and "migration_parity" in fewer.coverage["ran"]


def test_plan_and_workbook_checks_fold_and_gaps_show(spark, build, tmp_path):
    from buildproof.sources.workbook import read_workbooks

    (tmp_path / "a.twb").write_text("<workbook><datasources><datasource name='d' caption='D'><connection class='snowflake'><relation type='text' name='q'>SELECT 1</relation></connection><column name='[c]' caption='C'><calculation formula='{FIXED : SUM([x])}'/></column></datasource></datasources></workbook>")
    parts = read_workbooks(spark, str(tmp_path / "*.twb"))
    run = run_checks(Context(build, workbooks=parts), [Spec("T-LOD-001"), Spec("T-NAME-001"), Spec("T-CALC-003"), Spec("P-SPILL-001"), Spec("P-COST-001"), Spec("S-STAT-001")])
    assert [r.status for r in run.results] == ["WARN", "SKIP", "PASS", "PASS", "SKIP", "SKIP"] and run.verdict == "READY_WITH_NOTES"
    assert run.coverage["left_out"] == ["migration_parity", "assertions", "regression", "metadata", "static", "tableau_live"]
    (tmp_path / "b.twb").write_text("no workbook")
    unread = run_checks(Context(build, workbooks=read_workbooks(spark, str(tmp_path / "*.twb"))), [Spec("T-CALC-003")])
    assert unread.results[0].status == "ERROR" and unread.verdict == "READY_WITH_NOTES"
