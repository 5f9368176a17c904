"""Reading Spark's own plans: what a query is made of, taken from the parser and the analyser."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    """The statement is more than a single read."""


#: Plan nodes that a read may consist of, by their names in the parser's output.
READ_NODES = frozenset(
    "Project Aggregate Filter Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit Limit Offset Tail Distinct Deduplicate Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedWith UnresolvedCTERelationDef LocalRelation OneRowRelation UnresolvedInlineTable UnresolvedHaving Generate WithWindowDefinition Window UnresolvedTableValuedFunction "
    "UnresolvedTVFAliases Pivot UnresolvedPivot Unpivot UnresolvedUnpivot Sample Range PipeExpression PipeOperator".split()
)


def items(seq) -> list:
    """Elements of a Scala sequence."""
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parse(spark: SparkSession, sql: str):
    """The parsed plan of exactly one statement, nothing resolved."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def inputs(plan) -> list:
    """Plans directly below: children, common table expressions, and subqueries in expressions."""
    found = items(plan.children())
    if kind(plan) == "UnresolvedWith":
        found += [pair._2() for pair in items(plan.cteRelations())]
    return found + items(plan.subqueries())


def walk(plan) -> Iterator:
    """All plan nodes, the root first."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(inputs(node))


def expressions(plan) -> Iterator:
    """All expressions of one plan node, with those inside them."""
    stack = items(plan.expressions())
    while stack:
        e = stack.pop()
        yield e
        stack += items(e.children())


def text_of(node) -> str:
    """The stretch of the statement that a node was parsed from."""
    origin = node.origin()
    if origin.sqlText().isEmpty() or origin.startIndex().isEmpty():
        return ""
    return origin.sqlText().get()[int(origin.startIndex().get()) : int(origin.stopIndex().get()) + 1]


def assert_read_only(spark: SparkSession, sql: str) -> None:
    """Raise NotReadOnly unless the text is a single statement that only reads (or an EXPLAIN of one)."""
    if not sql.strip().rstrip(";").strip():
        raise NotReadOnly("the statement is empty")
    try:
        plan = parse(spark, sql)
    except Exception as error:
        raise NotReadOnly(f"not one statement of this dialect: {str(error).splitlines()[0]}") from error
    if kind(plan) == "ExplainCommand":
        plan = plan.logicalPlan()
    for node in walk(plan):
        if kind(node) not in READ_NODES:
            raise NotReadOnly(f"{kind(node)} is no read")


def table_names(spark: SparkSession, sql: str) -> list[str]:
    """Tables that a query reads, without its common table expressions, in order and once each."""
    plan = parse(spark, sql)
    local = {pair._1().lower() for node in walk(plan) if kind(node) == "UnresolvedWith" for pair in items(node.cteRelations())}
    found = [".".join(items(node.multipartIdentifier())) for node in walk(plan) if kind(node) == "UnresolvedRelation"]
    return list({name.lower(): name for name in found if name.lower() not in local}.values())


def column_sources(df: DataFrame) -> dict[str, list[str]]:
    """For every output column the source columns (table.column) that its value is computed from, by attribute identity."""
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, set[int]] = {}
    named: dict[int, str] = {}

    def attributes(e) -> set[int]:
        out, stack = set(), [e]
        while stack:
            x = stack.pop()
            if kind(x) == "AttributeReference":
                out.add(x.exprId().id())
            stack += items(x.children())
        return out

    def visit(node, alias: str) -> None:
        name = kind(node)
        if name == "SubqueryAlias":
            alias = alias or node.alias()
        if name in ("LogicalRelation", "HiveTableRelation", "LocalRelation", "LogicalRDD", "DataSourceV2Relation", "Range", "View"):
            for a in items(node.output()):
                if name != "View":
                    named[a.exprId().id()] = f"{alias or name}.{a.name()}"
        if name == "Union":
            arms = [items(c.output()) for c in items(node.children())]
            for k, a in enumerate(items(node.output())):
                made.setdefault(a.exprId().id(), set()).update(arm[k].exprId().id() for arm in arms)
        for e in items(node.expressions()):
            if kind(e) == "Alias":
                made.setdefault(e.exprId().id(), set()).update(attributes(e))
        for child in items(node.children()):
            visit(child, alias if name in ("SubqueryAlias", "View", "Project") and len(items(node.children())) == 1 else "")

    visit(plan, "")

    def sources(i: int, seen: frozenset) -> set[str]:
        if i in named:
            return {named[i]}
        return set().union(*[sources(j, seen | {i}) for j in made.get(i, ()) if j not in seen and j != i]) if i in made else set()

    return {a.name(): sorted(sources(a.exprId().id(), frozenset())) for a in items(plan.output())}


def scan_facts(df: DataFrame) -> list[dict[str, str]]:
    """Per scan of the physical plan: pushed filters, partition filters and columns read."""
    plan = df._jdf.queryExecution().sparkPlan()
    out, stack = [], [plan]
    while stack:
        node = stack.pop()
        if "FileSourceScanExec" in kind(node) or kind(node) == "BatchScanExec":
            facts = node.metadata()
            out.append({k: facts.get(k).get() for k in ("PushedFilters", "PartitionFilters", "ReadSchema", "Location") if facts.contains(k)})
        stack += items(node.children())
    return out
