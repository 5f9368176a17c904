"""Running checks on a build: all scalar metrics in one pass, the others a job each."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.pii import safe_sample
from ..operators.evidence import counted
from ..sources.scratch import written
from .registry import CHECKS, Check, Context, result
from .verdict import FAMILIES, Result, coverage, summary, verdict

#: What a check may need of a run besides its own parameters.
GIVEN = {"build": "build", "baseline": "baseline", "queries": "query text", "workbooks": "workbook", "migrated": "snapshot to compare with", "resolution": "object map"}
#: Findings shown.
NAMED = 10


@dataclass(frozen=True)
class Spec:
    """A check to run and how."""

    id: str
    params: Mapping[str, Any] = field(default_factory=dict)
    enabled: bool = True
    severity: str | None = None


@dataclass(frozen=True)
class Run:
    results: list[Result]
    verdict: str
    summary: dict[str, int]
    coverage: dict[str, Any]


def _blocked(check: Check, spec: Spec, ctx: Context) -> Result | None:
    """A SKIP result if something that the check needs is not there."""
    needs = [n for n in check.needs if n not in GIVEN and spec.params.get(n) in (None, "", [], ())]
    if needs:
        return result(check, "SKIP", f"not configured: {', '.join(needs)}", severity=spec.severity)
    for n in check.needs:
        if n in GIVEN and (getattr(ctx, n) is None or getattr(ctx, n) == ()):
            return result(check, "SKIP", f"there is no {GIVEN[n]}", severity=spec.severity)
    have = {c.upper() for c in ctx.build.columns}
    missing = [c for c in check.columns(spec.params) if c.upper() not in have]
    if missing:
        return result(check, "SKIP", f"the build has no column {', '.join(missing)}", severity=spec.severity)
    return None


def _columns(ctx: Context, some: list[tuple[int, Check, Spec]]) -> tuple[list[Column], list[tuple[int, str]]]:
    """The metric columns of some checks, and the check and name that each belongs to."""
    columns, where = [], []
    for at, check, spec in some:
        params = dict(spec.params) | ({"as_of": ctx.as_of} if ctx.as_of else {})
        for name, column in check.metrics(ctx.build, params).items():
            columns.append(column.alias(f"m{len(columns)}"))
            where.append((at, name))
    return columns, where


def _by_check(where: list[tuple[int, str]], values: Mapping[str, Any]) -> dict[int, dict[str, Any]]:
    out: dict[int, dict[str, Any]] = {}
    for k, (at, name) in enumerate(where):
        out.setdefault(at, {})[name] = values[f"m{k}"]
    return out


def _scalar(ctx: Context, wanted: list[tuple[int, Check, Spec]]) -> dict[int, dict[str, Any] | Exception]:
    """Metric values per check: from one pass, or one by one where that fails, so that a bad check fails alone."""

    def measure(some):
        columns, where = _columns(ctx, some)
        return _by_check(where, ctx.build.agg(*columns).first().asDict())

    if not wanted:
        return {}
    try:
        return measure(wanted)
    except Exception:
        out: dict[int, Any] = {}
        for one in wanted:
            try:
                out |= measure([one])
            except Exception as error:
                out[one[0]] = error
        return out


def _scans_only(build: DataFrame) -> bool:
    """Whether a build is a filtered or projected scan of one table, which costs no more to read again than a copy of it."""
    node = build._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("SubqueryAlias", "View", "Project", "Filter"):
        node = node.child()
    return node.getClass().getSimpleName() in ("LogicalRelation", "LocalRelation", "Range", "LogicalRDD", "OneRowRelation")


def _settled(ctx: Context, scalar: list[tuple[int, Check, Spec]]) -> tuple[Context, dict[int, Any] | None]:
    """The context with a copy of the build that was written once, and the metrics observed in the job that wrote it.

    Row checks then read the copy, so that the build's sources are scanned once however many checks there are. Metrics are None if there are none to
    observe, or one of them broke the job: then the copy is written without them, and they are taken of it.
    """
    columns, where = _columns(ctx, scalar)
    if columns:
        seen = Observation()
        try:
            copy = written(ctx.build.observe(seen, *columns), "build")
            # an empty plan may report nothing
            values = seen.get if copy.limit(1).count() else None
            return replace(ctx, build=copy), None if values is None else _by_check(where, values)
        except Exception:  # a metric of bad data; a bad build fails again below
            pass
    return replace(ctx, build=written(ctx.build, "build")), None


def _sampled(df: DataFrame, ctx: Context, first: tuple[str, ...]) -> tuple[int, list[dict]]:
    """How many rows there are, and a few of them, the same in every run, with personal data hidden before they leave the executors. One job."""
    cap = 0 if ctx.aggregate_only else ctx.evidence_rows
    show = (lambda some: safe_sample(some, cap, ctx.pii_names)) if ctx.redact else (lambda some: some)
    n, rows = counted(df, cap, [F.desc(c) for c in first if c in df.columns], show)
    return n, [r.asDict(recursive=True) for r in rows]


def _folded(found: list[tuple[str, str]], expected: str) -> tuple[str, str, str]:
    """The worst status of the findings of one check, and what is found of it; no finding is a pass."""
    status = next((s for s in ("FAIL", "ERROR", "WARN", "SKIP") if any(s == f[0] for f in found)), "PASS")
    told = [what for s, what in found if s == status and what]
    return status, "; ".join(told[:NAMED]) + (f" and {len(told) - NAMED} more" if len(told) > NAMED else ""), expected


def run_checks(ctx: Context, specs: Iterable[Spec]) -> Run:
    """Results in the order of specs; a check that raises becomes an ERROR and stops nothing else."""
    specs = [s for s in specs if s.enabled]
    found: dict[int, Result] = {}
    scalar, grouped = [], []
    for at, spec in enumerate(specs):
        check = CHECKS.get(spec.id)
        if check is None:
            found[at] = Result(spec.id, spec.id, "assertions", spec.severity or "INFO", "SKIP", "no such check")
        elif (blocked := _blocked(check, spec, ctx)) is not None:
            found[at] = blocked
        else:
            (scalar if check.metrics else grouped).append((at, check, spec))
    began = time.monotonic()
    values, on_rows = None, ctx
    if any(check.rows for _, check, _ in grouped) and not _scans_only(ctx.build):
        try:
            on_rows, values = _settled(ctx, scalar)
        except Exception:  # the build breaks: every check says so by itself
            on_rows = ctx
    values = _scalar(on_rows, scalar) if values is None else values
    each = int((time.monotonic() - began) * 1000)
    for at, check, spec in scalar:
        found[at] = _decided(check, spec, values[at], each)
    for at, check, spec in grouped:
        began = time.monotonic()
        try:
            value: Any = check.first(on_rows, spec.params) if check.first else _folded(check.find(ctx, spec.params), check.name) if check.find else None
            if value is None:
                n, sample = _sampled(check.rows(on_rows, spec.params), ctx, check.worst)
                value = {"rows": n, "sample": sample}
        except Exception as error:
            value = error
        found[at] = _decided(check, spec, value, int((time.monotonic() - began) * 1000))
    results = [found[at] for at in sorted(found)]
    return Run(results, verdict(results), summary(results), coverage(results, FAMILIES))


def _decided(check: Check, spec: Spec, value: Any, took: int) -> Result:
    name = f"D-CUSTOM:{spec.params.get('name')}" if check.id == "D-CUSTOM-001" else check.id
    severity = spec.params.get("severity", spec.severity) if check.id == "D-CUSTOM-001" else spec.severity
    if isinstance(value, Exception):
        made = result(check, "ERROR", str(value).splitlines()[0][:300], severity=severity, duration_ms=took)
    else:
        status, observed, expected = value if isinstance(value, tuple) else check.decide(spec.params, value)
        sample = value.get("sample", []) if status == "FAIL" and not isinstance(value, tuple) else []
        made = result(check, status, observed, expected, severity, sample=sample, duration_ms=took)
    return replace(made, id=name)
