"""Rulesets: which checks run, how severe they are and within what limits, read from YAML and overlaid by profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..functions.pii import NAMES
from .registry import CHECKS, SLA_HOURS
from .runner import Spec
from .verdict import SEVERITIES, VERDICTS

# Tokens of database and schema names that mark a layer a build must not read.
SANDBOX = ("SANDBOX", "SCRATCH", "TMP", "TEMP", "WIP", "DEV", "PERSONAL", "PLAYGROUND")
RAW = ("RAW", "BRONZE", "LANDING", "STAGING", "STG", "SRC", "INGEST")


@dataclass(frozen=True)
class Defaults:
    """fail_on: the verdict from which a run fails; the others bound what a run reads and shows."""

    fail_on: str = "REVIEW"
    max_result_rows: int = 100_000
    statement_timeout_s: int = 120
    evidence_sample_rows: int = 20
    redact_pii: bool = True
    aggregate_only: bool = False


@dataclass(frozen=True)
class Ruleset:
    version: str
    defaults: Defaults = Defaults()
    naming: Mapping[str, str | None] = field(default_factory=dict)
    deprecated_objects: tuple[str, ...] = ()
    certified_sources: tuple[str, ...] = ()
    sandbox_patterns: tuple[str, ...] = SANDBOX
    raw_layer_patterns: tuple[str, ...] = RAW
    integration_layer_patterns: tuple[str, ...] = ()
    pii_column_patterns: tuple[str, ...] = NAMES
    severity_overrides: Mapping[str, str] = field(default_factory=dict)
    thresholds: Mapping[str, Any] = field(default_factory=dict)
    checks: tuple[Spec, ...] = ()

    def specs(self) -> list[Spec]:
        """The checks to run, with limits, lists of names and severities of the ruleset where a check gives none itself."""
        shared = {
            "deprecated": self.deprecated_objects, "certified": self.certified_sources, "sandbox": self.sandbox_patterns,
            "raw": self.raw_layer_patterns, "integration": self.integration_layer_patterns,
        }
        own = {
            "D-NULL-002": {"threshold": self.thresholds.get("null_rate_default", 0.0)},
            "D-FRESH-001": {"sla_hours": self.thresholds.get("freshness_sla_hours_default", SLA_HOURS)},
            "T-NAME-001": {"field_regex": self.naming.get("tableau_field_regex")},
        }
        out = []
        for s in self.checks:
            check = CHECKS.get(s.id)
            given = own.get(s.id, {}) | (shared if check and check.family in ("static", "metadata", "tableau_static") else {})
            out.append(replace(s, params={k: v for k, v in given.items() if v} | dict(s.params), severity=s.severity or self.severity_overrides.get(s.id)))
        return out

    def fails(self, verdict: str) -> bool:
        return VERDICTS.index(verdict) <= VERDICTS.index(self.defaults.fail_on)


_LISTS = ("deprecated_objects", "certified_sources", "sandbox_patterns", "raw_layer_patterns", "integration_layer_patterns", "pii_column_patterns")


def read_mapping(path: str | Path) -> dict[str, Any]:
    """A YAML file whose root is a mapping."""
    import yaml

    try:
        found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as error:
        raise ValueError(f"there is no file {path}") from error
    except yaml.YAMLError as error:
        raise ValueError(f"{path} is no YAML: {error}") from error
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def known_only(raw: Mapping[str, Any], allowed, where: str) -> None:
    if extra := sorted(set(raw) - set(allowed)):
        raise ValueError(f"{where}: unknown fields {extra}")


def _spec(raw: Mapping[str, Any]) -> Spec:
    known_only(raw, ("id", "enabled", "params", "severity"), "a check")
    if not raw.get("id"):
        raise ValueError("a check has no id")
    return Spec(raw["id"], dict(raw.get("params") or {}), bool(raw.get("enabled", True)), raw.get("severity"))


def make(raw: Mapping[str, Any], where: str = "ruleset") -> Ruleset:
    """A ruleset from a mapping. Unknown fields, severities and verdicts, and patterns that don't compile, are refused."""
    known_only(raw, [f.name for f in fields(Ruleset)], where)
    version = raw.get("version")
    if not isinstance(version, str) or not version or re.search(r"\s", version):
        raise ValueError(f"{where}: a version without white space is needed")
    given = dict(raw.get("defaults") or {})
    known_only(given, [f.name for f in fields(Defaults)], f"{where}.defaults")
    defaults = Defaults(**given)
    if defaults.fail_on not in VERDICTS[:3]:
        raise ValueError(f"{where}.defaults.fail_on: {defaults.fail_on!r} is none of {VERDICTS[:3]}")
    if min(defaults.max_result_rows, defaults.statement_timeout_s) <= 0 or defaults.evidence_sample_rows < 0:
        raise ValueError(f"{where}.defaults: limits must be positive")
    naming = dict(raw.get("naming") or {})
    known_only(naming, ("table_regex", "tableau_field_regex"), f"{where}.naming")
    severities = dict(raw.get("severity_overrides") or {})
    if wrong := sorted(v for v in severities.values() if v not in SEVERITIES):
        raise ValueError(f"{where}.severity_overrides: unknown {wrong}")
    thresholds = dict(raw.get("thresholds") or {})
    if not 0 <= thresholds.get("null_rate_default", 0) <= 1 or thresholds.get("freshness_sla_hours_default", 1) <= 0:
        raise ValueError(f"{where}.thresholds: out of bounds")
    lists = {k: tuple(raw[k]) for k in _LISTS if k in raw}
    for pattern in (*lists.get("pii_column_patterns", ()), *(v for v in naming.values() if v)):
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"{where}: {pattern!r} is no pattern: {error}") from error
    return Ruleset(version, defaults, naming, severity_overrides=severities, thresholds=thresholds, checks=tuple(map(_spec, raw.get("checks") or ())), **lists)


def load(path: str | Path, pin: str | None = None) -> Ruleset:
    """The ruleset in a file; pin: the only version that is accepted."""
    found = make(read_mapping(path), str(path))
    if pin is not None and found.version != pin:
        raise ValueError(f"{path} has version {found.version}, but {pin} is pinned")
    return found


def read_pin(path: str | Path) -> str | None:
    return Path(path).read_text(encoding="utf-8").strip() or None if Path(path).exists() else None


def write_pin(path: str | Path, version: str) -> None:
    """Pin a version: the only one that runs naming this file accept."""
    make({"version": version}, "pin")
    Path(path).write_text(version + "\n", encoding="utf-8")


def pull(source: str | Path, folder: str | Path) -> list[str]:
    """Copy the rulesets and profiles of a folder, once all of the rulesets can be read; the names of what was copied."""
    files = sorted(f for f in Path(source).rglob("*") if f.suffix.lower() in (".yml", ".yaml"))
    if not files:
        raise ValueError(f"{source} has no rulesets")
    for f in files:
        raw = read_mapping(f)
        if "version" in raw:  # a profile has none
            make(raw, str(f))
    for f in files:
        to = Path(folder) / f.relative_to(source)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(f.read_bytes())
    return [str(f.relative_to(source)) for f in files]


def overlaid(base: Ruleset, profile: Mapping[str, Any], where: str = "profile") -> Ruleset:
    """The ruleset with a profile on top: defaults, naming, severities and thresholds by field, lists extended, checks replaced by id or added."""
    known_only(profile, ["name", "description", *(f.name for f in fields(Ruleset) if f.name != "version")], where)
    raw: dict[str, Any] = {"version": base.version, "defaults": {f.name: getattr(base.defaults, f.name) for f in fields(Defaults)} | dict(profile.get("defaults") or {})}
    for name in ("naming", "severity_overrides", "thresholds"):
        raw[name] = dict(getattr(base, name)) | dict(profile.get(name) or {})
    for name in _LISTS:
        raw[name] = list(dict.fromkeys([*getattr(base, name), *(profile.get(name) or ())]))
    found = make(raw, where)
    checks = {s.id: s for s in base.checks} | {s.id: s for s in map(_spec, profile.get("checks") or ())}
    return replace(found, checks=tuple(checks.values()))
