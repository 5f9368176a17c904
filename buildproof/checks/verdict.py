"""Severities, statuses and the verdict that check results fold into."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("BLOCKER", "HIGH", "MEDIUM", "LOW", "INFO")
STATUSES = ("PASS", "FAIL", "WARN", "SKIP", "ERROR")
#: Worst first.
VERDICTS = ("BLOCKED", "REVIEW", "READY_WITH_NOTES", "READY")
# Families of checks, the riskiest to leave out first.
FAMILIES = ("migration_parity", "assertions", "regression", "metadata", "static", "performance", "tableau_static", "tableau_live")
EXIT_CODES = {"READY": 0, "READY_WITH_NOTES": 0, "REVIEW": 1, "BLOCKED": 2}
TOOL_ERROR = 3


@dataclass(frozen=True)
class Result:
    """What one check found."""

    id: str
    name: str
    family: str
    severity: str
    status: str
    observed: str = ""
    expected: str = ""
    sample: list[dict[str, Any]] = field(default_factory=list)
    remediation: str = ""
    duration_ms: int = 0


def verdict(results: Iterable[Result]) -> str:
    """The worst verdict that any result calls for."""
    worst = len(VERDICTS) - 1
    for r in results:
        if r.status == "FAIL" and r.severity == "BLOCKER":
            call = 0
        elif (r.status == "FAIL" and r.severity == "HIGH") or (r.status == "ERROR" and r.severity in ("BLOCKER", "HIGH")):
            call = 1
        elif r.status in ("FAIL", "ERROR", "WARN"):
            call = 2
        else:
            continue
        worst = min(worst, call)
    return VERDICTS[worst]


def verdict_column() -> Column:
    """The same fold as an aggregate over rows with severity and status."""
    is_in = lambda status, *severities: F.max(F.col("status").eqNullSafe(status) & F.col("severity").isin(*severities))
    return (
        F.when(is_in("FAIL", "BLOCKER"), VERDICTS[0])
        .when(is_in("FAIL", "HIGH") | is_in("ERROR", "BLOCKER", "HIGH"), VERDICTS[1])
        .when(F.max(F.col("status").isin("FAIL", "ERROR", "WARN")), VERDICTS[2])
        .otherwise(VERDICTS[3])
    )


def roll_up(results: DataFrame, *by: str) -> DataFrame:
    """Verdict and number of failures of every object of an estate. results: by..., severity, status."""
    return results.groupBy(*by).agg(verdict_column().alias("verdict"), F.count_if(F.col("status") == "FAIL").alias("failures"))


def worst(verdicts: Iterable[str | None]) -> str | None:
    """Of several objects; one that broke off (None) counts as blocked. None if there are none."""
    ranks = [0 if v is None else VERDICTS.index(v) for v in verdicts]
    return VERDICTS[min(ranks)] if ranks else None


def summary(results: Iterable[Result]) -> dict[str, int]:
    """Numbers of results by status, and of failures by severity."""
    results = list(results)
    return {s.lower(): sum(r.status == s for r in results) for s in STATUSES} | {f"{s.lower()}_failures": sum(r.severity == s and r.status == "FAIL" for r in results) for s in SEVERITIES}


def coverage(results: Iterable[Result], applicable: Iterable[str]) -> dict[str, Any]:
    """Which families ran, which were left out whole, and which checks were skipped in those that ran."""
    results = list(results)
    ran = {r.family for r in results if r.status not in ("SKIP",)}
    wanted = [f for f in FAMILIES if f in set(applicable)]
    gaps = [r.id for r in results if r.status == "SKIP" and r.family in ran]
    return {"ran": [f for f in wanted if f in ran], "left_out": [f for f in wanted if f not in ran], "skipped_checks": gaps}
