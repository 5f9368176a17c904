"""The checks that can be run on a build: each names its metrics, so that all of them share one pass, and a decision on the numbers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assertions as A
from ..functions.pii import NAMES
from .verdict import Result

Params = Mapping[str, Any]


@dataclass(frozen=True)
class Check:
    """metrics: scalar columns over the build (fused with those of other checks); rows: a DataFrame of violations instead.

    first: a decision that needs no data, or None if the rows must decide. find: (status, what) of each finding on the query texts,
    the measured plan, workbooks or a migration, instead of metrics and rows.
    """

    id: str
    name: str
    family: str
    severity: str
    needs: tuple[str, ...]
    decide: Callable[[Params, Mapping[str, Any]], tuple[str, str, str]] | None = None
    metrics: Callable[[DataFrame, Params], dict[str, Column]] | None = None
    rows: Callable[["Context", Params], DataFrame] | None = None
    first: Callable[["Context", Params], tuple[str, str, str] | None] | None = None
    find: Callable[["Context", Params], list[tuple[str, str]]] | None = None
    columns: Callable[[Params], list[str]] = lambda p: []
    #: Columns of the rows by which the worst are shown first.
    worst: tuple[str, ...] = ()


@dataclass
class Context:
    """What a run is about: the build, its baseline, and other tables by name.

    kept: store and name of the baseline, so that R-DIFF-001 can go by its tree of digests.
    queries: the texts that the build reads with; workbooks: the parts that read_workbooks() gives; migrated: store, name of the
    snapshot, migrated table and Entry; resolution: of the object map. measured: what several checks share.
    """

    build: DataFrame
    baseline: DataFrame | None = None
    kept: tuple | None = None
    tables: Mapping[str, DataFrame] | None = None
    evidence_rows: int = 20
    aggregate_only: bool = False
    pii_names: tuple[str, ...] = NAMES
    redact: bool = True
    as_of: str | None = None
    queries: tuple[str, ...] = ()
    workbooks: DataFrame | None = None
    migrated: tuple | None = None
    resolution: Any = None
    measured: dict = field(default_factory=dict)

    def once(self, key, make: Callable[[], Any]) -> Any:
        if key not in self.measured:
            self.measured[key] = make()
        return self.measured[key]


#: What kind of value each parameter holds.
PARAM_KINDS = {
    **dict.fromkeys(("key", "columns", "allowed", "deprecated", "certified", "sandbox", "raw", "integration"), "list"),
    **dict.fromkeys(("fk_column", "ref_table", "ref_column", "column", "event_ts_col", "name", "severity", "field_regex"), "str"),
    **dict.fromkeys(("metric_sql", "source_of_truth_sql", "sql"), "sql"),
    **dict.fromkeys(("threshold", "tolerance_abs", "tolerance_pct", "sla_hours", "min", "max", "blow_up"), "float"),
    **dict.fromkeys(("min_rows", "max_rows", "max_bytes", "max_files", "max_filters"), "int"),
    "need_user_filter": "bool",
}
#: Parameters that checks take beside those that they need, by check.
OPTIONAL = {
    "D-GRAIN-002": ("min_rows", "max_rows"),
    "D-NULL-002": ("threshold",),
    "D-BLANK-001": ("threshold",),
    "D-RANGE-001": ("min", "max"),
    "D-DISTINCT-001": ("min", "max"),
    "D-FRESH-001": ("sla_hours",),
    "D-RECON-001": ("tolerance_abs", "tolerance_pct"),
    "D-CUSTOM-001": ("severity",),
    "R-AGG-001": ("tolerance_pct",),
    "S-STAT-007": ("deprecated",),
    "S-STAT-012": ("sandbox",),
    "S-STAT-013": ("raw",),
    "S-STAT-015": ("integration",),
    "S-META-003": ("deprecated",),
    "S-META-004": ("certified",),
    "P-COST-001": ("max_bytes", "max_files"),
    "P-CARD-001": ("blow_up",),
    "T-SRC-003": ("certified",),
    "T-NAME-001": ("field_regex",),
    "T-FILT-001": ("max_filters",),
    "T-RLS-001": ("need_user_filter",),
}

#: Hours that a build may be old unless a limit is given.
SLA_HOURS = 24.0

CHECKS: dict[str, Check] = {}


def register(check: Check) -> Check:
    if check.id in CHECKS:
        raise ValueError(f"{check.id} is registered already")
    CHECKS[check.id] = check
    return check


def parameters(check: Check) -> list[dict[str, Any]]:
    """name, type and required of every parameter of a check, for forms and specs."""
    needed = [n for n in check.needs if n in PARAM_KINDS]
    return [{"name": n, "type": PARAM_KINDS[n], "required": n in needed} for n in (*needed, *OPTIONAL.get(check.id, ()))]


def catalogue() -> list[dict[str, Any]]:
    """Every check with its family, severity, what it needs of a run, and its parameters."""
    return [{"id": c.id, "name": c.name, "family": c.family, "severity": c.severity, "needs": [n for n in c.needs if n not in PARAM_KINDS], "params": parameters(c)} for c in CHECKS.values()]


def result(check: Check, status: str, observed: str = "", expected: str = "", severity: str | None = None, **more) -> Result:
    return Result(check.id, check.name, check.family, severity or check.severity, status, observed, expected, **more)


def _any(values: Mapping[str, Any], what: str, expected: str) -> tuple[str, str, str]:
    bad = {k: v for k, v in values.items() if v}
    return ("FAIL" if bad else "PASS"), ", ".join(f"{k}: {v} {what}" for k, v in bad.items()) or f"no {what}", expected


def _rates(params: Params, values: Mapping[str, Any], default: float, what: str) -> tuple[str, str, str]:
    total, limit = values["total"], params.get("threshold", default)
    if not total:
        return "WARN", "the build is empty", f"{what} rate at most {limit}"
    bad = {k: v / total for k, v in values.items() if k != "total" and v / total > limit}
    return ("FAIL" if bad else "PASS"), ", ".join(f"{k}: {v:.4g}" for k, v in bad.items()), f"{what} rate at most {limit}"


def _bounds(value, low, high, what: str) -> tuple[str, str, str]:
    bad = (low is not None and value < low) or (high is not None and value > high)
    return ("FAIL" if bad else "PASS"), f"{value} {what}", f"{'-' if low is None else low} to {'-' if high is None else high}"


def _fresh(params: Params, values: Mapping[str, Any]) -> tuple[str, str, str]:
    age, limit = values["age"], params.get("sla_hours", SLA_HOURS)
    if age is None:
        return "WARN", "no timestamp", f"at most {limit} h old"
    return ("FAIL" if age > limit else "PASS"), f"{age:.2f} h old", f"at most {limit} h old"


def _age(df: DataFrame, params: Params) -> dict[str, Column]:
    now = F.lit(params["as_of"]).cast("timestamp_ntz") if params.get("as_of") else F.localtimestamp()
    latest = F.max(F.col(params["event_ts_col"]).cast("timestamp_ntz"))
    return {"age": F.timestamp_diff("MICROSECOND", latest, now) / 3.6e9}


def _listed(params: Params, key: str) -> list[str]:
    return list(params[key])


per = lambda metric, key: lambda df, p: {c: metric(c) for c in p[key]}
total = lambda metric, key: lambda df, p: {"total": A.row_count()} | {c: metric(c) for c in p[key]}

register(Check("D-GRAIN-002", "row count within bounds", "assertions", "HIGH", (), lambda p, v: _bounds(v["rows"], p.get("min_rows"), p.get("max_rows"), "rows"), lambda df, p: {"rows": A.row_count()}))
register(Check("D-NULL-001", "key is not null", "assertions", "BLOCKER", ("key",), lambda p, v: _any(v, "nulls", "no nulls in the key"), per(A.null_count, "key"), columns=lambda p: _listed(p, "key")))
register(Check("D-NULL-002", "null rate", "assertions", "MEDIUM", ("columns",), lambda p, v: _rates(p, v, 0.0, "null"), total(A.null_count, "columns"), columns=lambda p: _listed(p, "columns")))
register(Check("D-BLANK-001", "blank rate", "assertions", "MEDIUM", ("columns",), lambda p, v: _rates(p, v, 0.0, "blank"), total(A.blank_count, "columns"), columns=lambda p: _listed(p, "columns")))
register(Check("D-POS-001", "no negative values", "assertions", "HIGH", ("columns",), lambda p, v: _any(v, "negative values", "none below zero"), per(A.negative_count, "columns"), columns=lambda p: _listed(p, "columns")))
register(Check("D-DOMAIN-001", "allowed values", "assertions", "MEDIUM", ("column", "allowed"), lambda p, v: _any(v, "values outside the set", "allowed values only"), lambda df, p: {p["column"]: A.outside_domain(df, p["column"], p["allowed"])}, columns=lambda p: [p["column"]]))
register(Check("D-RANGE-001", "values within bounds", "assertions", "MEDIUM", ("column",), lambda p, v: _any(v, "values out of bounds", f"{p.get('min')} to {p.get('max')}"), lambda df, p: {p["column"]: A.outside_range(p["column"], p.get("min"), p.get("max"))}, columns=lambda p: [p["column"]]))
register(Check("D-FRESH-001", "freshness", "assertions", "HIGH", ("event_ts_col",), _fresh, _age, columns=lambda p: [p["event_ts_col"]]))
register(Check("D-GRAIN-001", "key is unique", "assertions", "BLOCKER", ("key",), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} key groups with more than one row", "one row per key"), rows=lambda ctx, p: A.duplicate_groups(ctx.build, p["key"]), worst=("dup_count",), columns=lambda p: _listed(p, "key")))
register(Check("D-DUP-001", "no duplicate rows", "assertions", "MEDIUM", (), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} duplicated row groups", "none"), rows=lambda ctx, p: A.duplicate_rows(ctx.build), worst=("dup_count",)))
register(Check("D-RI-001", "no orphans", "assertions", "HIGH", ("fk_column", "ref_table", "ref_column"), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} orphans", "every key has a parent"), rows=lambda ctx, p: A.orphans(ctx.build, p["fk_column"], (ctx.tables or {})[p["ref_table"]], p["ref_column"]), columns=lambda p: [p["fk_column"]]))
register(Check("D-DISTINCT-001", "number of distinct values", "assertions", "MEDIUM", ("column",), lambda p, v: _bounds(v["rows"], p.get("min"), p.get("max"), "distinct values"), rows=lambda ctx, p: ctx.build.select(p["column"]).dropna().distinct(), columns=lambda p: [p["column"]]))


def _recon(params: Params, values: Mapping[str, Any]) -> tuple[str, str, str]:
    m, t = values["sample"][0]["metric"] if values["sample"] else None, values["sample"][0]["truth"] if values["sample"] else None
    if m is None or t is None:
        return "ERROR", "a side gave no number", "two numbers"
    allowed = max(params.get("tolerance_abs", 0.0), abs(t) * params.get("tolerance_pct", 0.0))
    return ("FAIL" if abs(m - t) > allowed else "PASS"), f"{m} against {t}", f"within {allowed}"


def _recon_rows(ctx: Context, params: Params) -> DataFrame:
    spark = ctx.build.sparkSession
    return A.reconcile(spark.sql(params["metric_sql"]), spark.sql(params["source_of_truth_sql"]))


def _custom_rows(ctx: Context, params: Params) -> DataFrame:
    import re

    from ..plans.catalyst import assert_read_only

    ctx.build.createOrReplaceTempView("__target")
    sql = re.sub(r"\{\{\s*target\s*\}\}", "__target", params["sql"])
    assert_read_only(ctx.build.sparkSession, sql)
    return ctx.build.sparkSession.sql(sql)


def _diff_rows(ctx: Context, params: Params) -> DataFrame:
    from ..operators.regression import row_changes

    if ctx.kept is not None:
        store, name = ctx.kept
        return store.row_changes(name, ctx.build)
    return row_changes(ctx.build, ctx.baseline)


def _diff_first(ctx: Context, params: Params) -> tuple[str, str, str] | None:
    """Columns that only one side has, or that are numeric on one side only, fail before any row is read.

    Other figures of the fingerprint can't move while all rows are the same, so the rows decide on them.
    """
    from ..operators.regression import kind_changes, schema_changes

    added, removed = schema_changes(ctx.build, ctx.baseline)
    found = {"columns added": added, "columns removed": removed, "columns numeric on one side only": kind_changes(ctx.build, ctx.baseline)}
    told = "; ".join(f"{what}: {', '.join(names)}" for what, names in found.items() if names)
    return ("FAIL", told, "the baseline's columns and rows") if told else None


register(Check("D-RECON-001", "ties out", "assertions", "BLOCKER", ("metric_sql", "source_of_truth_sql"), _recon, rows=_recon_rows))
register(Check("D-CUSTOM-001", "own assertion", "assertions", "MEDIUM", ("name", "sql"), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} rows returned", "no rows"), rows=_custom_rows))
register(Check("R-DIFF-001", "same rows as the baseline", "regression", "HIGH", ("baseline",), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} different rows added or removed", "the baseline's rows"), rows=_diff_rows, first=_diff_first))


def _agg_rows(ctx: Context, params: Params) -> DataFrame:
    from ..operators.regression import fingerprint, fingerprint_breaches

    return fingerprint_breaches(fingerprint(ctx.build, irregular=True), fingerprint(ctx.baseline, irregular=True), params.get("tolerance_pct", 0.0))


register(Check("R-AGG-001", "same sums and counts as the baseline", "regression", "MEDIUM", ("baseline",), lambda p, v: (("FAIL" if v["rows"] else "PASS"), f"{v['rows']} figures moved", "the baseline's figures"), rows=_agg_rows))


def _static(check: str) -> Callable[[Context, Params], list[tuple[str, str]]]:
    def find(ctx: Context, params: Params) -> list[tuple[str, str]]:
        from ..plans import static

        lists = {k: tuple(params[k]) for k in ("deprecated", "certified", "sandbox", "raw", "integration") if params.get(k)}
        found = ctx.once(("static", repr(lists)), lambda: [f for q in ctx.queries for f in static.check(ctx.build.sparkSession, q, **lists)])
        return [(f.status, f.text) for f in found if f.check == check]

    return find


def _resolved(ctx: Context) -> list:
    """One row for each table that a query names, with what the catalog knows of it."""
    from ..sources.catalog import of_queries

    return ctx.once("references", lambda: of_queries(ctx.build.sparkSession, ctx.queries).orderBy("query", "reference").collect())


def _missing(ctx: Context, params: Params) -> list[tuple[str, str]]:
    return [("FAIL", n) for n in dict.fromkeys(r.reference for r in _resolved(ctx) if r.kind is None)]


def _mismatched(ctx: Context, params: Params) -> list[tuple[str, str]]:
    """A query whose tables or columns the catalog doesn't know leaves its keys open: that is a warning."""
    from pyspark.errors import AnalysisException

    from ..plans.static import mismatched_keys

    out = []
    for q in ctx.queries:
        try:
            out += [("FAIL", f"{c}: {a} and {b}") for c, a, b in mismatched_keys(ctx.build.sparkSession, q)]
        except AnalysisException as error:
            out.append(("WARN", f"the types of keys can't be told: {str(error).splitlines()[0][:200]}"))
    return out


def _deprecated(ctx: Context, params: Params) -> list[tuple[str, str]]:
    listed = {d.lower() for d in params.get("deprecated", ())}
    return [("FAIL", n) for n in dict.fromkeys(r.reference for r in _resolved(ctx) if r.reference.lower() in listed or "DEPRECATED" in (r.comment or "").upper())]


def _measured(check: str) -> Callable[[Context, Params], list[tuple[str, str]]]:
    def find(ctx: Context, params: Params) -> list[tuple[str, str]]:
        from ..plans import fanout, performance

        ran = ctx.once("ran", lambda: performance.fresh(ctx.build))
        facts = ctx.once("facts", lambda: performance.measured(ran))
        status = performance.judge(facts, **{k: params[k] for k in ("max_bytes", "max_files", "blow_up") if k in params})[check]
        told = ", ".join(f"{k}: {v}" for k, v in facts.items())
        if check == "P-CARD-001":
            grown = ctx.once(("joins", params.get("blow_up", 10)), lambda: [j for j in fanout.joins(ran, params.get("blow_up", 10)) if j.growth >= params.get("blow_up", 10)])
            named = [f"{j.how} join on {j.on or 'nothing'}: {j.left} and {j.right} rows gave {j.out}" + (f", most for key {j.key} with about {j.times} rows" if j.key is not None else "") for j in grown]
            return [("WARN", n) for n in named] or [(status, told)]
        return [(status, told)]

    return find


def _workbook(check: str) -> Callable[[Context, Params], list[tuple[str, str]]]:
    def find(ctx: Context, params: Params) -> list[tuple[str, str]]:
        from ..sources.workbook import findings

        given = {k: tuple(params[k]) if k == "certified" else params[k] for k in ("certified", "field_regex", "max_filters", "need_user_filter") if k in params}
        lacking = {"T-NAME-001": "field_regex", "T-RLS-001": "need_user_filter"}.get(check)
        if lacking and not given.get(lacking):
            return [("SKIP", f"not configured: {lacking}")]
        found = ctx.once(("workbooks", repr(given)), lambda: findings(ctx.workbooks, **given).collect())  # one row per finding on a part
        # a workbook that can't be read leaves every check on it open
        return [(r.status, f"{r.path}: {r.subject}") for r in found if r.check in (check, "T-READ-001")]

    return find


def _migrated(check: str) -> Callable[[Context, Params], list[tuple[str, str]]]:
    def find(ctx: Context, params: Params) -> list[tuple[str, str]]:
        from . import migration

        store, name, target, entry = ctx.migrated
        if check == "M-SNAP-001":
            found = [migration.check_snapshots(store, [name])]
        else:
            found = ctx.once("migrated", lambda: migration.check_object(store, name, target, entry))
        return [(r.status, r.observed) for r in found if r.id == check]

    return find


def _sources(check: str) -> Callable[[Context, Params], list[tuple[str, str]]]:
    def find(ctx: Context, params: Params) -> list[tuple[str, str]]:
        from ..sources.workbook import relations
        from . import migration

        found = ctx.once("sources", lambda: migration.check_sources(relations(ctx.workbooks)))
        return [(r.status, r.observed) for r in found if r.id == check]

    return find


def _mapped(ctx: Context, params: Params) -> list[tuple[str, str]]:
    from . import migration

    found = migration.check_map(ctx.resolution)
    return [(found.status, found.observed)]


def _family(family: str, needs: str, make: Callable[[str], Callable], rows: str) -> None:
    for line in rows.strip().splitlines():
        id, severity, name = line.strip().split(" ", 2)
        register(Check(id, name, family, severity, (needs,), find=make(id)))


_family("static", "queries", _static, """
    S-STAT-001 HIGH no star
    S-STAT-002 BLOCKER joins have conditions
    S-STAT-003 HIGH no NOT IN of a subquery
    S-STAT-004 MEDIUM no comparison across types
    S-STAT-005 LOW no function over a filtered column
    S-STAT-006 MEDIUM no literal dates
    S-STAT-007 HIGH no deprecated objects
    S-STAT-008 MEDIUM joins say their kind
    S-STAT-010 MEDIUM no DISTINCT over joins
    S-STAT-011 LOW no ORDER BY in a subquery
    S-STAT-012 HIGH no sandbox
    S-STAT-013 MEDIUM no raw layer
    S-STAT-014 HIGH outer joins stay outer
    S-STAT-015 HIGH no integration layer
    D-ADD-001 MEDIUM no sum of ratios""")
_family("metadata", "queries", lambda id: {"S-META-001": _missing, "S-META-002": _mismatched, "S-META-003": _deprecated}.get(id) or _static(id), """
    S-META-001 BLOCKER tables exist
    S-META-002 HIGH join keys are of one kind
    S-META-003 HIGH no deprecated tables
    S-META-004 MEDIUM certified sources""")
_family("performance", "build", _measured, """
    P-PROF-001 LOW partitions are pruned
    P-COST-001 LOW bytes and files read
    P-SPILL-001 LOW no spill
    P-CARD-001 MEDIUM rows don't multiply""")
_family("tableau_static", "workbooks", _workbook, """
    T-SRC-001 MEDIUM no custom SQL
    T-SRC-002 MEDIUM no extracts
    T-SRC-003 HIGH certified datasources
    T-LOD-001 HIGH no fixed levels of detail
    T-CALC-001 MEDIUM no aggregates of ratios
    T-CALC-002 MEDIUM no literals in calculations
    T-CALC-003 MEDIUM calculations refer to known ones
    T-NAME-001 LOW names of fields
    T-UNUSED-001 LOW no unused calculations
    T-FILT-001 LOW number of filters
    T-RLS-001 HIGH row-level security
    T-TOTAL-001 MEDIUM no totals of averages""")
_family("migration_parity", "migrated", _migrated, """
    M-SNAP-001 BLOCKER snapshots are there
    M-SCHEMA-001 BLOCKER same columns and kinds of type
    M-ROW-001 BLOCKER same number of rows
    M-AGG-001 HIGH same sums and extremes
    M-NULL-001 HIGH same share of nulls
    M-DIST-001 HIGH same number of keys
    M-GRAIN-001 HIGH same groups
    M-HASH-001 HIGH same rows""")
_family("migration_parity", "workbooks", _sources, """
    M-SRC-001 HIGH comparable sources
    M-SRC-002 INFO refused sources""")
_family("migration_parity", "resolution", lambda id: _mapped, """
    M-MAP-001 BLOCKER objects are mapped""")
