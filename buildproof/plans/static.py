"""Faults that show in a query's text alone, found on Spark's parsed plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .catalyst import expressions, inputs, items, kind, parse, text_of, walk

COMPARISONS = frozenset("EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual".split())


@dataclass(frozen=True)
class Finding:
    check: str
    severity: str
    status: str
    text: str


def _function(e) -> str:
    return ".".join(items(e.nameParts())).lower() if kind(e) == "UnresolvedFunction" else ""


def _column(e) -> list[str] | None:
    return items(e.nameParts()) if kind(e) == "UnresolvedAttribute" else None


def _inside(e):
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += items(x.children())


def _stars(node):
    for e in items(node.expressions()):
        stack = [(e, False)]
        while stack:
            x, counted = stack.pop()
            if kind(x) == "UnresolvedStar" and not counted:
                yield text_of(x) or "*"
            stack += [(c, counted or _function(x) == "count") for c in items(x.children())]


def _join_type(node) -> str:
    return kind(node.joinType())


def _looks_like_date(text: str) -> bool:
    return len(text) >= 8 and sum(c.isdigit() for c in text) >= 6 and sum(c in "-/" for c in text) >= 2


def _below_same_block(node):
    """Nodes of the query block that a node heads, without those of its subqueries."""
    stack = list(items(node.children()))
    while stack:
        x = stack.pop()
        yield x
        if kind(x) not in ("SubqueryAlias", "UnresolvedWith", "Union", "Intersect", "Except"):
            stack += items(x.children())


def _tokens(name: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", name.lower()) if t}


def _unordered_limit(plan):
    """Sorts inside subqueries that no limit makes use of."""
    stack = [(plan, False, False)]
    while stack:
        node, inner, limited = stack.pop()
        name = kind(node)
        if name == "Sort" and inner and not limited:
            yield node
        below = inner or name == "SubqueryAlias"
        keeps = limited or name in ("GlobalLimit", "LocalLimit")
        sub = {id(x) for x in items(node.subqueries())}
        ctes = [p._2() for p in items(node.cteRelations())] if name == "UnresolvedWith" else []
        for child in items(node.children()):
            stack.append((child, below, keeps and name in ("GlobalLimit", "LocalLimit")))
        for child in ctes + [x for x in items(node.subqueries()) if id(x) in sub]:
            stack.append((child, True, False))


def check(spark: SparkSession, sql: str, deprecated=(), certified=(), sandbox=(), raw=(), integration=()) -> list[Finding]:
    """All findings for one query. The token lists name database or schema parts that a build must not read."""
    plan = parse(spark, sql)
    out: list[Finding] = []
    add = lambda *a: out.append(Finding(*a))
    local = {p._1().lower() for n in walk(plan) if kind(n) == "UnresolvedWith" for p in items(n.cteRelations())}
    for node in walk(plan):
        name = kind(node)
        for star in _stars(node):
            add("S-STAT-001", "HIGH", "FAIL", star)
        if name == "Join" and node.condition().isEmpty():
            text, how = text_of(node).lstrip().lower(), _join_type(node)
            filtered = any(kind(x) == "Filter" for x in walk(plan))
            if how in ("Cross", "NaturalJoin", "UsingJoin") or text.startswith(("cross", "natural")):
                pass
            elif text.startswith(("inner", "left", "right", "full")) or not filtered:
                add("S-STAT-002", "BLOCKER", "FAIL", text_of(node))
        if name == "Join" and not node.condition().isEmpty() and text_of(node).lstrip().lower().startswith("join"):
            add("S-STAT-008", "MEDIUM", "WARN", text_of(node))
        if name == "Distinct" and kind(node.child()) not in ("Union", "Intersect", "Except") and any(kind(x) == "Join" for x in _below_same_block(node)):
            add("S-STAT-010", "MEDIUM", "WARN", "DISTINCT over joins")
        if name == "Filter":
            outer = [x for x in _below_same_block(node) if kind(x) == "Join" and _join_type(x) in ("LeftOuter", "FullOuter")]
            asked, tested = set(), set()
            for e in expressions(node):
                if kind(e) == "UnresolvedAttribute" and len(_column(e)) > 1:
                    asked.add(_column(e)[0].lower())
                if kind(e) == "IsNull" and _column(e.child()) and len(_column(e.child())) > 1:
                    tested.add(_column(e.child())[0].lower())
            for join in outer:
                right = {x.alias().lower() for x in walk(join.right()) if kind(x) == "SubqueryAlias"} | {items(x.multipartIdentifier())[-1].lower() for x in walk(join.right()) if kind(x) == "UnresolvedRelation"}
                for alias in sorted((right & asked) - tested):
                    add("S-STAT-014", "HIGH", "WARN", f"WHERE on {alias} makes the outer join an inner one")
        for e in expressions(node):
            what = kind(e)
            if what == "Not" and kind(e.child()) == "InSubquery":
                add("S-STAT-003", "HIGH", "FAIL", text_of(e) or "NOT IN (subquery)")
            if what == "Literal" and e.dataType().simpleString() == "string" and _looks_like_date(str(e.value())):
                add("S-STAT-006", "MEDIUM", "WARN", str(e.value()))
            if what in COMPARISONS and (name == "Filter" or name == "Join"):
                sides = [e.left(), e.right()]
                literal = any(kind(s) == "Literal" and s.dataType().simpleString() == "string" for s in sides) and any(_column(s) for s in sides)
                if literal or any(kind(s) == "Cast" for s in sides):
                    add("S-STAT-004", "MEDIUM", "WARN", text_of(e))
                if name == "Filter" and any(_function(s) and any(_column(x) for x in _inside(s)) for s in sides):
                    add("S-STAT-005", "LOW", "WARN", text_of(e))
            if _function(e) == "sum":
                argument = items(e.children())[0]
                if kind(argument) == "Divide" or _function(argument) == "avg":
                    add("D-ADD-001", "MEDIUM", "WARN", text_of(e))
        if name == "UnresolvedRelation":
            parts = items(node.multipartIdentifier())
            full = ".".join(parts)
            if full.lower() in local:
                continue
            if full.lower() in {d.lower() for d in deprecated}:
                add("S-STAT-007", "HIGH", "FAIL", full)
            if certified and len(parts) > 1 and full.lower() not in {c.lower() for c in certified}:
                add("S-META-004", "MEDIUM", "WARN", full)
            around = set().union(*[_tokens(p) for p in parts[:-1]]) if len(parts) > 1 else set()
            for check_id, severity, tokens in (("S-STAT-012", "HIGH", sandbox), ("S-STAT-013", "MEDIUM", raw), ("S-STAT-015", "HIGH", integration)):
                if around & {t.lower() for t in tokens}:
                    add(check_id, severity, "FAIL", full)
    for node in _unordered_limit(plan):
        add("S-STAT-011", "LOW", "WARN", text_of(node) or "ORDER BY in a subquery")
    return list(dict.fromkeys(out))


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog knows a table by exactly this name, whose parts may be schema, or catalog and schema. Names of a catalog that isn't there are unknown."""
    try:
        return spark.catalog.tableExists(name)
    except Exception as error:
        # an unknown catalog, or more parts than the catalog's names have
        if getattr(error, "getCondition", lambda: None)() in ("CATALOG_NOT_FOUND", "REQUIRES_SINGLE_PART_NAMESPACE", "SCHEMA_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "IDENTIFIER_TOO_MANY_NAME_PARTS") or "CatalogNotFound" in str(error):
            return False
        raise


def _family(kind_name: str) -> str:
    for family, pattern in (("number", r"tinyint|smallint|int|bigint|float|double|decimal"), ("datetime", "date|timestamp"), ("semistructured", "array|map|struct|variant")):
        if re.match(pattern, kind_name):
            return family
    return kind_name


def mismatched_keys(spark: SparkSession, sql: str) -> list[tuple[str, str, str]]:
    """(condition, type, type) of equi-joins whose sides differ in kind once the casts that analysis adds are taken off (S-META-002).

    A condition may stand at the join or, for tables joined by comma, in a WHERE above it.
    """
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    out = []

    def bare(e):
        while kind(e) == "Cast":
            e = e.child()
        return e

    def ties(a, b, node) -> bool:
        """Whether some join at or below a node has one expression on either side."""
        stack = [node]
        while stack:
            n = stack.pop()
            if kind(n) == "Join":
                left, right = n.left().outputSet(), n.right().outputSet()
                if any(not x.references().isEmpty() and x.references().subsetOf(left) and not y.references().isEmpty() and y.references().subsetOf(right) for x, y in ((a, b), (b, a))):
                    return True
            if kind(n) in ("Join", "Filter", "SubqueryAlias"):
                stack += inputs(n)
        return False

    stack = [plan]
    while stack:
        node = stack.pop()
        condition = node.condition().get() if kind(node) == "Join" and not node.condition().isEmpty() else node.condition() if kind(node) == "Filter" else None
        for e in _inside(condition) if condition is not None else ():
            if kind(e) == "EqualTo":
                sides = [bare(s) for s in (e.left(), e.right())]
                a, b = (s.dataType().simpleString() for s in sides)
                if _family(a) != _family(b) and (kind(node) == "Join" or ties(*sides, node.child())):
                    out.append((e.sql(), a, b))
        stack += inputs(node)
    return out
