"""Migration parity: snapshots of legacy objects, and the checks of migrated ones against them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import parity as P
from ..sources.baseline import BaselineStore
from ..sources.mapping import Entry, Resolution
from .verdict import Result, verdict, worst

FAMILY = "migration_parity"
#: Names listed in an observation.
NAMED = 10


def _made(check: str, name: str, severity: str, status: str, observed: str = "", expected: str = "") -> Result:
    return Result(check, name, FAMILY, severity, status, observed, expected)


def _few(names: Iterable[str]) -> str:
    names = list(names)
    return ", ".join(names[:NAMED]) + (f" and {len(names) - NAMED} more" if len(names) > NAMED else "")


def snapshot_name(workbook: str, datasource: str, label: str) -> str:
    """A name that is safe as a folder and still tells apart what cleaning makes equal."""
    clean = lambda s: re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_") or "x"
    mark = hashlib.sha256("\0".join((workbook, datasource, label)).encode()).hexdigest()[:6]
    return f"parity__{clean(workbook)}__{clean(datasource)}__{clean(label)}__{mark}"


def save_snapshot(store: BaselineStore, name: str, legacy: DataFrame, entry: Entry) -> None:
    """Metrics, grain groups and row hashes of a legacy object, all of them, with its schema."""
    missing = [c for c in (*entry.keys, *entry.grain) if c.upper() not in {x.upper() for x in legacy.columns}]
    if missing:
        raise ValueError(f"{entry.old} has no column {_few(missing)}")
    keys, grain = P.spelled(entry.keys, legacy.columns), P.spelled(entry.grain, legacy.columns)
    if grain:
        store.save(f"{name}__grain", P.grain_groups(legacy, grain))
    if keys:
        hashed = P.hashed_rows(legacy, keys)
        store.save(f"{name}__rows", hashed, tree=True, keys=keys, unique=P.repeated_keys(hashed, keys).isEmpty())
    store.save(f"{name}__metrics", P.measure(legacy, keys), object=entry.old, measured_schema=legacy.schema.jsonValue())


def check_sources(relations: DataFrame) -> list[Result]:
    """M-SRC-001: something can be compared; M-SRC-002: what can't, and why."""
    counts = {r.kind: r["count"] for r in relations.groupBy((F.col("kind") == "refused").alias("kind")).count().collect()}
    refused = relations.filter("kind = 'refused'").select("datasource", "detail").collect()  # one row per datasource of a workbook
    status = "FAIL" if not counts.get(False) else "WARN" if refused else "PASS"
    out = [_made("M-SRC-001", "comparable sources", "HIGH", status, f"{counts.get(False, 0)} of {sum(counts.values())} can be compared", "all")]
    return out + [_made("M-SRC-002", "refused source", "INFO", "SKIP", f"{r.datasource}: {r.detail}") for r in refused]


def check_map(resolution: Resolution) -> Result:
    """M-MAP-001: every legacy object has a target."""
    lost = [*resolution.unmapped, *resolution.uninvertible]
    return _made("M-MAP-001", "objects are mapped", "BLOCKER", "FAIL" if lost else "PASS", _few(lost), "no object without a target")


def check_snapshots(store: BaselineStore, names: Iterable[str]) -> Result:
    """M-SNAP-001: every object that is compared has a snapshot."""
    lost = [n for n in names if not store.exists(f"{n}__metrics")]
    return _made("M-SNAP-001", "snapshots are there", "BLOCKER", "FAIL" if lost else "PASS", _few(lost), "a snapshot for each object")


def _difference(check: str, name: str, severity: str, found: DataFrame | None, describe, why_not: str, expected: str) -> Result:
    if found is None:
        return _made(check, name, severity, "SKIP", why_not)
    rows = found.limit(NAMED + 1).collect()
    more = found.count() - NAMED if len(rows) > NAMED else 0  # counted only where there is more than is named
    told = ", ".join(describe(r) for r in rows[:NAMED]) + (f" and {more} more" if more else "")
    return _made(check, name, severity, "FAIL" if rows else "PASS", told, expected)


def missing_target(why: str) -> Result:
    """M-SCHEMA-001 of an object whose migrated table isn't there: nothing of it can be compared."""
    return _made("M-SCHEMA-001", "same columns and kinds of type", "BLOCKER", "FAIL", why, "every legacy column")


def check_object(store: BaselineStore, name: str, target: DataFrame, entry: Entry, row_tolerance: float = 0.0) -> list[Result]:
    """The comparisons of one migrated object with its snapshot. Columns are compared under their legacy names and spelling."""
    spark = target.sparkSession
    old_schema = StructType.fromJson(store.manifest(f"{name}__metrics")["measured_schema"])
    live = P.respelled(P.renamed(target, {new: old for old, new in entry.columns.items()}), old_schema.names)
    entry = replace(entry, keys=tuple(P.spelled(entry.keys, old_schema.names)), grain=tuple(P.spelled(entry.grain, old_schema.names)))
    wrong = P.compare_schemas(spark.createDataFrame([], old_schema), live)
    out = [_made("M-SCHEMA-001", "same columns and kinds of type", "BLOCKER", "FAIL" if wrong else "PASS", _few(f"{c}: {w}" for c, w in wrong), "every legacy column")]
    gone = {c.upper() for c, _ in wrong}
    keys = [k for k in entry.keys if k.upper() not in gone]
    shared = [c for c in old_schema.names if c in live.columns]
    old, new = store.load(f"{name}__metrics"), P.measure(live.select(*shared), keys)
    changed = lambda r: f"{r.kind} {r.col_name}: {r.old_value:g} became {r.new_value:g}"
    ranked = lambda df: df.filter("breach").orderBy(F.desc("diff"), "col_name", "kind")
    out.append(_difference("M-ROW-001", "same number of rows", "BLOCKER", ranked(P.compare_metrics(old, new, ["row_count"], row_tolerance)), changed, "", "the same number"))
    out.append(_difference("M-AGG-001", "same sums and extremes", "HIGH", ranked(P.compare_metrics(old, new, ["sum", "min", "max", "nan", "inf", "-inf"], entry.tolerance)), changed, "", f"within {entry.tolerance:g}"))
    out.append(_difference("M-NULL-001", "same share of nulls", "HIGH", ranked(P.compare_nulls(old, new, entry.tolerance)), changed, "", f"within {entry.tolerance:g}"))
    out.append(_difference("M-DIST-001", "same number of keys", "HIGH", ranked(P.compare_metrics(old, new, ["distinct"], entry.tolerance)) if entry.keys else None, changed, "no keys declared", f"within {entry.tolerance:g}"))
    grain = P.compare_grain(store.load(f"{name}__grain"), P.grain_groups(live, entry.grain), entry.grain, entry.tolerance) if entry.grain and not gone & {g.upper() for g in entry.grain} else None
    out.append(_difference("M-GRAIN-001", "same groups", "HIGH", grain, lambda r: f"{tuple(r[g] for g in entry.grain)}: {r.state}", "no grain declared or measured", "the same groups"))
    out.append(_check_rows(store, name, live, entry, keys, shared, old_schema))
    return out


def _check_rows(store, name, live, entry, keys, shared, old_schema) -> Result:
    """By the tree of the snapshot: one scan of the live rows for their digests, then only leaves that differ are read on either side.

    Where a leaf's keys are those of the snapshot, in which no key repeats, none repeats in the live rows either; so only leaves of other keys are looked at for that.
    """
    about = ("M-HASH-001", "same rows", "HIGH")
    if not entry.keys:
        return _made(*about, "SKIP", "no keys declared")
    if len(keys) < len(entry.keys) or len(shared) < len(old_schema):
        return _made(*about, "WARN", "the columns differ, so rows can't be compared")
    kept, now, manifest = store.load(f"{name}__rows"), P.hashed_rows(live, entry.keys, shared), store.manifest(f"{name}__rows")
    leaves, mine, theirs = store.changed_leaves(f"{name}__rows", now) or (None, now, kept)
    if not manifest.get("unique", leaves is None and P.repeated_keys(kept, entry.keys).isEmpty()):
        return _made(*about, "ERROR", "the key is not unique in the legacy rows")
    if (leaves is None or not leaves.filter("keys_differ").isEmpty()) and not P.repeated_keys(mine, entry.keys).isEmpty():
        return _made(*about, "ERROR", "the key is not unique in the migrated rows")
    found = P.changed_keys(theirs, mine, entry.keys)
    return _difference(*about, found, lambda r: f"{tuple(r[k] for k in entry.keys)}: {'different' if r.state == 'mismatch' else r.state}", "", "the same rows by key")


@dataclass(frozen=True)
class Workbook:
    """The outcome of one workbook of an estate; results are None if its run broke off."""

    path: str
    results: list[Result] | None


def check_estate(workbooks: Iterable[Workbook]) -> tuple[list[Result], str | None]:
    """M-ESTATE-001 and -002 over the verdicts of all workbooks, and the worst verdict."""
    verdicts: Mapping[str, str | None] = {w.path: None if w.results is None else verdict(w.results) for w in workbooks}
    blocked = [p for p, v in verdicts.items() if v in (None, "BLOCKED")]
    review, notes = ([p for p, v in verdicts.items() if v == kind] for kind in ("REVIEW", "READY_WITH_NOTES"))
    first = "WARN" if not verdicts else "FAIL" if blocked else "PASS"
    second = "SKIP" if not verdicts else "FAIL" if review else "WARN" if notes else "PASS"
    return [
        _made("M-ESTATE-001", "no workbook is blocked", "BLOCKER", first, _few(blocked) or ("the estate is empty" if not verdicts else ""), "none"),
        _made("M-ESTATE-002", "no workbook needs review", "HIGH", second, _few(review or notes), "none"),
    ], worst(verdicts.values())
