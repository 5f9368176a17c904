"""Build scripts: several statements folded into one DataFrame without running any DDL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .catalyst import READ_NODES, NotReadOnly, assert_read_only, kind, parse, walk

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)
_CREATE = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|TEMP(?:ORARY)?\s+|TRANSIENT\s+)*(?:VIEW|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`\"]+)\s*(?:\([^)]*\)\s*)?(?:USING\s+\w+\s+)?AS\s+(.*)\Z", re.I | re.S)
_ROLES = (("key", re.compile(r"(?i)(?:^|_)(?:id|key|code|no|num)$|(?:id|key)$")), ("timestamp", re.compile(r"(?i)(?:_at|_ts|_date|date|time|timestamp)$")), ("amount", re.compile(r"(?i)amount|price|revenue|total|cost|balance|qty|quantity")))


@dataclass
class Build:
    result: DataFrame
    name: str | None
    steps: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)


def statements(script: str) -> list[str]:
    """The statements of a script; semicolons in strings, names and comments don't end one."""
    out, start = [], 0
    for m in _TOKEN.finditer(script):
        if m.group() == ";":
            out.append(script[start : m.start()])
            start = m.end()
    out.append(script[start:])
    blank = lambda s: not _TOKEN.sub(lambda m: "" if m.group().startswith(("--", "/*")) else m.group(), s).strip()
    return [s.strip() for s in out if not blank(s)]


def fold(spark: SparkSession, script: str) -> Build:
    """The build that a script makes: views and tables it creates become temporary views, the last read is the result.

    A trailing SELECT wins unless a later CREATE ... AS follows it. Statements that neither read nor create are skipped and named.
    """
    found = Build(None, None)
    for statement in statements(script):
        body = _TOKEN.sub(lambda m: " " if m.group().startswith(("--", "/*")) else m.group(), statement)
        made = _CREATE.match(body)
        query = made[2] if made else body
        try:
            readable = all(kind(n) in READ_NODES for n in walk(parse(spark, query)))
        except Exception:
            if made or re.match(r"(?i)\s*(?:select|with|values|table|\()", body):
                raise
            readable = False
        if not readable:
            found.skipped.append(statement)
            continue
        assert_read_only(spark, query)
        found.result = spark.sql(query)
        found.queries.append(query)
        if made:
            found.name = re.sub(r'[`"]', "", made[1])
            view = found.name.rsplit(".", 1)[-1]
            found.result.createOrReplaceTempView(view)
            found.steps.append(view)
        else:
            found.name = None
    if found.result is None:
        raise ValueError("the script has no statement that reads")
    return found


def created(spark: SparkSession, script: str) -> list[tuple[str | None, str]]:
    """(name, query) of what a script creates, in order, and its other reads without a name. Nothing is run or registered; other statements are left out."""
    out: list[tuple[str | None, str]] = []
    for statement in statements(script):
        body = _TOKEN.sub(lambda m: " " if m.group().startswith(("--", "/*")) else m.group(), statement)
        made = _CREATE.match(body)
        try:
            assert_read_only(spark, made[2] if made else body)
        except NotReadOnly:
            if made:
                raise
            continue
        out.append((re.sub(r'[`"]', "", made[1]), made[2]) if made else (None, body))
    return out


def roles(df: DataFrame) -> dict[str, str]:
    """A role for columns whose names suggest one: key, amount, and at most one timestamp."""
    out: dict[str, str] = {}
    for c in df.columns:
        role = next((r for r, p in _ROLES if p.search(c)), None)
        if role and not (role == "timestamp" and "timestamp" in out.values()):
            out[c] = role
    return out
