"""Parity runs: a workbook's legacy objects are measured before a migration and compared after it; an estate is many workbooks."""

from __future__ import annotations

import glob
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..plans.catalyst import assert_read_only
from ..plans.lineage import projected_columns
from ..plans.static import table_exists
from ..sources import mapping
from ..sources.baseline import BaselineStore
from ..sources.workbook import read_workbooks, relations
from . import migration
from .limits import limited
from .ruleset import known_only, read_mapping
from .verdict import Result, verdict

MODES = ("snapshot", "check", "run")


# The fields of a manifest and what a snapshot prefix may be made of.
MANIFEST_FIELDS = ("version", "workbooks")
WORKBOOK_FIELDS = ("path", "map", "snapshot_prefix")
PREFIX = r"[a-z0-9_-]+"


@dataclass(frozen=True)
class Listed:
    """A workbook of an estate, the map of its objects and what its snapshots are named by."""

    path: str
    map: str | None = None
    snapshot_prefix: str | None = None

    def __post_init__(self):
        if self.snapshot_prefix is not None and not re.fullmatch(PREFIX, self.snapshot_prefix):
            raise ValueError(f"{self.path}: {self.snapshot_prefix!r} is no snapshot prefix")

    @property
    def prefix(self) -> str:
        return self.snapshot_prefix or re.sub(r"[^a-z0-9_-]+", "_", Path(self.path).stem.lower()).strip("_") or "workbook"


def _manifest_rows(file: Path, default_map: str | None) -> Iterator[Listed]:
    content = read_mapping(file)
    known_only(content, MANIFEST_FIELDS, str(file))
    if content.get("version") != 1:
        raise ValueError(f"{file}: version must be 1")
    beside = lambda name: str(file.parent / name)
    for row in content.get("workbooks") or ():
        known_only(row, WORKBOOK_FIELDS, str(file))
        yield Listed(beside(row["path"]), beside(row["map"]) if row.get("map") else default_map, row.get("snapshot_prefix"))


def clashes(rows: Iterable[Listed]) -> dict[str, list[str]]:
    """Paths by prefix, whatever its case, where several workbooks would write the same snapshots."""
    ordered = sorted((r.prefix.casefold(), r.path) for r in rows)
    grouped = {prefix: [path for _, path in members] for prefix, members in groupby(ordered, key=itemgetter(0))}
    return {prefix: paths for prefix, paths in grouped.items() if len(paths) > 1}


def estate_of(source: str, default_map: str | None = None) -> list[Listed]:
    """The workbooks that a YAML manifest lists, with paths relative to it, or else those that a glob finds. An estate has a workbook, and none of two share snapshots."""
    file = Path(source)
    is_manifest = file.is_file() and file.suffix.lower() in (".yml", ".yaml")
    rows = [*_manifest_rows(file, default_map)] if is_manifest else [Listed(p, default_map) for p in sorted(glob.glob(source, recursive=True))]
    if problem := "names no workbook" if not rows else f"lists workbooks that would share snapshots: {found}" if (found := clashes(rows)) else "":
        raise ValueError(f"{source} {problem}")
    return rows


class NoSuchObject(LookupError):
    """A table that neither the run's own names nor the catalog know by its full name."""


def read_object(spark: SparkSession, name: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The table of exactly this name: one of the given tables (full names, in any case), or the catalog's. No part of a name is ever left out."""
    given = {k.upper(): df for k, df in (tables or {}).items()}
    if name.upper() in given:
        return given[name.upper()]
    if not table_exists(spark, name):
        raise NoSuchObject(f"there is no table {name}")
    return spark.table(name)


@dataclass(frozen=True)
class _Object:
    snapshot: str
    entry: mapping.Entry
    legacy: Callable[[], DataFrame]
    target: Callable[[], DataFrame]


def _query(spark: SparkSession, sql: str) -> DataFrame:
    """The measurable columns of a custom query; all of them if they can't be told from its text."""
    assert_read_only(spark, sql)
    df, columns = spark.sql(sql), projected_columns(spark, sql)
    kept = [c for c in df.columns if columns is None or c.upper() in columns]
    return df.select(*[f"`{c}`" for c in kept]) if kept else df


def _objects(spark: SparkSession, workbook: Listed, parts: DataFrame, swapped: bool, identity: bool, tables: Mapping[str, DataFrame] | None) -> tuple[list[_Object], mapping.Resolution]:
    config = read_mapping(workbook.map) if workbook.map else {"version": 1}
    entries, ignore = mapping.load(config)
    rows = relations(parts).filter("kind <> 'refused'").collect()  # one row per datasource of a workbook
    names = [r.detail for r in rows if r.kind == "table"]
    resolution = mapping.resolve_post_swap(names, entries, ignore, identity) if swapped else mapping.resolve(names, entries, ignore, identity or not workbook.map)
    out = []
    for r in rows:
        if r.kind == "custom_sql":
            label = r.detail
            out.append(_Object(migration.snapshot_name(workbook.prefix, r.datasource, label), mapping.Entry(label, label), *[lambda sql=r.detail: _query(spark, sql)] * 2))
        elif r.detail in resolution.resolved:
            e = resolution.resolved[r.detail]
            out.append(_Object(migration.snapshot_name(workbook.prefix, r.datasource, e.old), e, lambda e=e: read_object(spark, e.old, tables), lambda e=e: read_object(spark, e.new, tables)))
    return out, resolution


def run_parity(spark: SparkSession, workbook: Listed, store: BaselineStore, mode: str = "run", swapped: bool = False, identity: bool = False, tables: Mapping[str, DataFrame] | None = None, static_only: bool = False) -> list[Result]:
    """The results of one workbook. snapshot: measure its legacy objects and keep that; check: compare the migrated ones; run: both.

    swapped: the workbook names the migrated objects already. tables: objects by their full names, beside those of the catalog. An object
    without a snapshot fails M-SNAP-001 and is not compared; a migrated one that isn't there fails M-SCHEMA-001. static_only: sources and map
    are checked and no table is read; it can't be asked of a run, whose second phase needs what the first one measures.
    """
    if static_only and mode == "run":
        raise ValueError("a run of both phases can't be static")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = read_workbooks(spark, workbook.path)
    out = migration.check_sources(relations(parts))
    objects, resolution = _objects(spark, workbook, parts, swapped, identity, tables)
    out.append(migration.check_map(resolution))
    if static_only:
        return out
    if mode in ("snapshot", "run"):
        for o in objects:
            migration.save_snapshot(store, o.snapshot, o.legacy(), o.entry)
    if mode in ("check", "run"):
        out.append(migration.check_snapshots(store, [o.snapshot for o in objects]))
        for o in objects:
            if store.exists(f"{o.snapshot}__metrics"):
                try:
                    target = o.target()
                except NoSuchObject as lost:
                    out.append(migration.missing_target(str(lost)))
                    continue
                out += migration.check_object(store, o.snapshot, target, o.entry)
    return out


@dataclass(frozen=True)
class Estate:
    """errors: why a workbook's run broke off. verdict: the worst of all; None only where there is no workbook."""

    mode: str
    workbooks: list[migration.Workbook]
    results: list[Result]
    verdict: str | None
    errors: Mapping[str, str] = field(default_factory=dict)

    def verdict_of(self, path: str) -> str:
        found = next(w for w in self.workbooks if w.path == path)
        return "BLOCKED" if found.results is None else verdict(found.results)


def _phase(spark: SparkSession, work: Listed, store: BaselineStore, phase: str, seconds: float | None, how: Mapping) -> list[Result]:
    """One workbook in a thread of its own: its jobs share a pool and a tag, by which they are cancelled when time is up."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", work.prefix)
    try:
        with limited(spark, job_tag(work), seconds):
            return run_parity(spark, work, store, phase, **how)
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def job_tag(work: Listed) -> str:
    """The tag of all jobs of a workbook, for spark.sparkContext.cancelJobsWithTag()."""
    return f"estate-{work.prefix}"


def run_estate(spark: SparkSession, workbooks: list[Listed], store: BaselineStore, mode: str = "run", at_once: int = 1, seconds: float | None = None, **how) -> Estate:
    """All workbooks, several at once. One that breaks off, takes longer than `seconds` in a phase or is cancelled is blocked and stops no other.

    In a run of both phases all are measured before any is compared, and one that can't be measured isn't compared. With
    spark.scheduler.mode=FAIR the workbooks share the executors evenly, so that a large one doesn't hold up the small ones.
    """
    if at_once < 1:
        raise ValueError("one workbook at once is the least")
    phases = ("snapshot", "check") if mode == "run" else (mode,)
    results: dict[str, list[Result] | None] = {w.path: [] for w in workbooks}
    errors: dict[str, str] = {}
    for phase in phases:
        with ThreadPoolExecutor(at_once) as pool:
            left = {w.path: pool.submit(inheritable_thread_target(spark)(_phase), spark, w, store, phase, seconds, how) for w in workbooks if results[w.path] is not None}
            for path, done in left.items():
                try:
                    results[path] = done.result()  # the last phase tells the same and more
                except Exception as error:
                    results[path], errors[path] = None, (str(error).splitlines() or [type(error).__name__])[0][:300]
    found = [migration.Workbook(w.path, results[w.path]) for w in workbooks]
    return Estate(mode, found, *migration.check_estate(found), errors)
