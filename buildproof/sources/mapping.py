"""The map from legacy objects to migrated ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

TOLERANCE = 0.01


@dataclass(frozen=True)
class Entry:
    """One object: where it was, where it is, its keys and grain (legacy names), renamed columns (old -> new) and tolerance."""

    old: str
    new: str
    keys: tuple[str, ...] = ()
    grain: tuple[str, ...] = ()
    columns: Mapping[str, str] = field(default_factory=dict)
    tolerance: float = TOLERANCE


@dataclass(frozen=True)
class Resolution:
    resolved: dict[str, Entry]
    unmapped: list[str]
    ignored: list[str]
    uninvertible: list[str] = field(default_factory=list)


def same_object(a: str, b: str) -> bool:
    """Names agree, whatever their case, in the parts that both have; at least two of them, or all."""
    x, y = a.upper().split("."), b.upper().split(".")
    n = min(len(x), len(y))
    return x[-n:] == y[-n:] and (n >= 2 or len(x) == len(y))


def load(config: Mapping) -> tuple[list[Entry], list[str]]:
    """(entries, ignored patterns) of a map as read from YAML; unknown fields and versions are refused."""
    if config.get("version") != 1:
        raise ValueError("map version must be 1")
    if extra := set(config) - {"version", "defaults", "objects", "ignore"}:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    defaults = config.get("defaults") or {}
    entries = []
    for o in config.get("objects") or []:
        if extra := set(o) - {"old", "new", "keys", "grain", "columns", "tolerance_pct"}:
            raise ValueError(f"unknown fields: {sorted(extra)}")
        entries.append(Entry(o["old"], o["new"], tuple(o.get("keys") or ()), tuple(o.get("grain") or ()), dict(o.get("columns") or {}), o.get("tolerance_pct", defaults.get("tolerance_pct", TOLERANCE))))
    seen = [e.old.upper() for e in entries]
    if len(set(seen)) < len(seen):
        raise ValueError("an object is mapped twice")
    return entries, list(config.get("ignore") or [])


def resolve(names: Iterable[str], entries: Iterable[Entry], ignore: Iterable[str] = (), identity: bool = False) -> Resolution:
    """What each legacy name maps to; with identity, unmapped names stay what they are."""
    entries, resolved, unmapped, ignored = list(entries), {}, [], []
    for name in dict.fromkeys(names):
        match = next((e for e in entries if same_object(e.old, name)), None)
        if match:
            resolved[name] = match
        elif any(fnmatchcase(name.upper(), p.upper()) for p in ignore):
            ignored.append(name)
        elif identity:
            resolved[name] = Entry(name, name)
        else:
            unmapped.append(name)
    return Resolution(resolved, unmapped, ignored)


def resolve_post_swap(names: Iterable[str], entries: Iterable[Entry], ignore: Iterable[str] = (), identity: bool = False) -> Resolution:
    """The same for a workbook that names the migrated objects already: each is found by its new name, so that its legacy snapshot is.

    A name that several entries could be, and one whose legacy name has no database, can't be told and are named as
    uninvertible. Two entries with one new name are an error of the map.
    """
    entries, resolved, unmapped, ignored, lost = list(entries), {}, [], [], []
    shared = sorted({e.new for e in entries if sum(o.new.upper() == e.new.upper() for o in entries) > 1})
    if shared:
        raise ValueError(f"several objects become one: {shared}")
    for name in dict.fromkeys(names):
        found = [e for e in entries if same_object(e.new, name)]
        if len(found) > 1:
            lost.append(f"{name} (may be {', '.join(e.old for e in found)})")
        elif found and found[0].old.count(".") < 2 <= found[0].new.count("."):
            lost.append(f"{name} (its legacy name {found[0].old} has no database)")
        elif found:
            resolved[name] = found[0]
        elif any(fnmatchcase(name.upper(), p.upper()) for p in ignore):
            ignored.append(name)
        elif identity:
            resolved[name] = Entry(name, name)
        else:
            unmapped.append(name)
    return Resolution(resolved, unmapped, ignored, lost)


def invert(entries: Iterable[Entry]) -> tuple[list[Entry], list[str]]:
    """(the map the other way, names that several objects became and that can't be told apart)."""
    entries = list(entries)
    shared = {e.new.upper() for e in entries if sum(o.new.upper() == e.new.upper() for o in entries) > 1}
    out = []
    for e in entries:
        back = {new: old for old, new in e.columns.items()}
        if e.new.upper() not in shared and len(back) == len(e.columns):
            out.append(Entry(e.new, e.old, tuple(e.columns.get(k, k) for k in e.keys), tuple(e.columns.get(k, k) for k in e.grain), back, e.tolerance))
    return out, sorted({e.new for e in entries} - {e.old for e in out})
