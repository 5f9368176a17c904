"""The catalog as tables, joined with what queries name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalyst import items, kind, parse, walk

TABLES = "catalog string, schema string, name string, kind string, comment string"
COLUMNS = "catalog string, schema string, name string, column string, type string, place int"
REFS = "query int, reference string, catalog string, schema string, name string"


def references(spark: SparkSession, queries: Iterable[str]) -> DataFrame:
    """REFS: every table that a query names, with the session's catalog and schema where the name has fewer parts; common table expressions are none.

    Only names of one part may be temporary views, whose catalog and schema are null in tables().
    """
    here = (spark.catalog.currentCatalog(), spark.catalog.currentDatabase())
    rows: dict[tuple, None] = {}
    for k, q in enumerate(queries):
        nodes = list(walk(parse(spark, q)))
        local = {p._1().lower() for n in nodes if kind(n) == "UnresolvedWith" for p in items(n.cteRelations())}
        for n in nodes:
            if kind(n) == "UnresolvedRelation":
                parts = items(n.multipartIdentifier())
                if len(parts) == 1 and parts[0].lower() in local:
                    continue
                full = [*here[: max(0, 3 - len(parts))], *parts]
                rows[k, ".".join(parts), full[0], ".".join(full[1:-1]), full[-1]] = None
    return spark.createDataFrame(list(rows), REFS)


def _schemas(spark: SparkSession, catalog: str) -> list[str]:
    return [r[0] for r in spark.sql(f"SHOW NAMESPACES IN {_quoted(catalog)}").toLocalIterator()]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _asked(spark: SparkSession, only: Iterable[tuple[str, str]] | None) -> list[tuple[str, str]]:
    if only is not None:
        return sorted(set(only))
    return [(c.name, s) for c in spark.catalog.listCatalogs() for s in _schemas(spark, c.name)]


def tables(spark: SparkSession, only: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """TABLES of all catalogs, or of some (catalog, schema); those that aren't there have none. Temporary views have no catalog."""
    rows, views = [], {}
    for catalog, schema in _asked(spark, only):
        try:
            found = spark.catalog.listTables(f"{_quoted(catalog)}.{_quoted(schema)}")
        except AnalysisException:  # no such catalog or schema
            continue
        for t in found:
            if t.isTemporary:
                views[t.name] = (None, None, t.name, "view", t.description)
            else:
                rows.append((catalog, schema, t.name, t.tableType.lower(), t.description))
    if only is not None and not views:
        views = {t.name: (None, None, t.name, "view", t.description) for t in spark.catalog.listTables() if t.isTemporary}
    return spark.createDataFrame([*rows, *views.values()], TABLES)


def columns(spark: SparkSession, found: DataFrame) -> DataFrame:
    """COLUMNS of the tables in a result of tables(): one row each, in the order of the table."""
    rows = []
    for t in found.toLocalIterator():
        name = ".".join(_quoted(x) for x in (t.catalog, t.schema, t.name) if x)
        rows += [(t.catalog, t.schema, t.name, f.name, f.dataType.simpleString(), k) for k, f in enumerate(spark.table(name).schema)]
    return spark.createDataFrame(rows, COLUMNS)


def resolved(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs with kind and comment of the table that each names, null where there is none. A temporary view hides a table of its name, whatever the case."""
    parts = ("catalog", "schema", "name")
    t = known.select(*[F.lower(p).alias(f"t_{p}") for p in parts], "kind", "comment")
    full = t.filter("t_catalog is not null").withColumnsRenamed({"kind": "table_kind", "comment": "table_comment"})
    views = t.filter("t_catalog is null").select(F.col("t_name").alias("v_name"), F.col("kind").alias("view_kind"), F.col("comment").alias("view_comment"))
    at = (F.lower("catalog") == F.col("t_catalog")) & (F.lower("schema") == F.col("t_schema")) & (F.lower("name") == F.col("t_name"))
    as_view = (F.lower("name") == F.col("v_name")) & ~F.contains("reference", F.lit("."))
    both = refs.join(full, at, "left").join(views, as_view, "left")
    return both.select(*refs.columns, F.coalesce("view_kind", "table_kind").alias("kind"), F.when(F.col("view_kind").isNotNull(), F.col("view_comment")).otherwise(F.col("table_comment")).alias("comment"))


def of_queries(spark: SparkSession, queries: Iterable[str]) -> DataFrame:
    """resolved() references of some queries, listing only the schemas that they name."""
    refs = references(spark, queries)
    named = [(r.catalog, r.schema) for r in refs.select("catalog", "schema").distinct().toLocalIterator()]
    return resolved(refs, tables(spark, named))
