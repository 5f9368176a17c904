"""Lineage across scripts: the columns of many scripts as one table of edges, followed through views by joins to a fixed point."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .build import created
from .lineage import OUTPUT, lineage

#: A column of this name stands for all columns of its source.
ALL = "*"
EDGE = "script string, source string, source_column string, target string, target_column string"
MAX_ROUNDS = 1000


def script_edges(spark: SparkSession, scripts: Mapping[str, str]) -> DataFrame:
    """EDGE rows of all scripts: which column of which table, view or inner block goes into which column of which.

    What a script creates is a node by its name, shared by all scripts; common table expressions and subqueries are nodes of their statement; a
    last SELECT feeds `script:<path>`. Names are in lower case. A star passes all columns on under their names.
    """
    rows: dict[tuple, None] = {}
    for path, text in scripts.items():
        for n, (name, query) in enumerate(created(spark, text)):
            graph = lineage(spark, query)
            target = f"table:{name.lower()}" if name else f"script:{path}"
            place = lambda node: target if node == OUTPUT else node if node.startswith("table:") else f"{path}#{n}:{node}"  # noqa: B023, E731
            for e in graph.edges:
                links = {(a.lower(), b.lower()) for a, b in e.links if a != ALL}
                if any(c == ALL or c.endswith(".*") for c in graph.nodes[e.target].columns) or not graph.nodes[e.target].columns:
                    links.add((ALL, ALL))
                rows |= {(path, place(e.source), a, place(e.target), b): None for a, b in links}
    return spark.createDataFrame(list(rows), EDGE)


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """origin, node, col of every column that each seed (origin, node, col) goes into, directly or through others.

    Each round joins only what the round before found, and drops what is known; so cycles end, and every column is followed once for each origin.
    """
    plain = edges.select(F.col("source").alias("node"), F.col("source_column").alias("col"), F.col("target").alias("to"), F.col("target_column").alias("to_col")).distinct()
    named_, stars = plain.filter(F.col("col") != ALL), plain.filter(F.col("col") == ALL).select("node", "to").distinct()
    new = seeds.select("origin", F.lower("node").alias("node"), F.lower("col").alias("col")).distinct()
    known, found = new, None
    for _ in range(MAX_ROUNDS):
        by_name = new.join(named_, ["node", "col"]).select("origin", F.col("to").alias("node"), F.col("to_col").alias("col"))
        by_star = new.join(stars, "node").select("origin", F.col("to").alias("node"), "col")
        new = written(by_name.union(by_star).distinct().join(known, ["origin", "node", "col"], "left_anti"), "lineage")
        if new.isEmpty():
            return found if found is not None else new
        known = known.union(new)
        found = new if found is None else found.union(new)
    raise RuntimeError(f"lineage did not end in {MAX_ROUNDS} rounds")


def dependents(edges: DataFrame, table: str, column: str) -> DataFrame:
    """node, col of all that depends on one column of a table or view."""
    seed = edges.sparkSession.createDataFrame([("", f"table:{table.lower()}", column.lower())], "origin string, node string, col string")
    return reached(edges, seed).select("node", "col")


def sources(edges: DataFrame, tables: Iterable[str] | None = None) -> DataFrame:
    """origin, node, col: what every column of the base tables (those that no script makes, or some of them) goes into."""
    made = edges.select(F.col("target").alias("source")).distinct()
    base = edges.filter(F.startswith("source", F.lit("table:")) & (F.col("source_column") != ALL)).join(made, "source", "left_anti")
    if tables is not None:
        base = base.filter(F.col("source").isin(*[f"table:{t.lower()}" for t in tables]))
    seeds = base.select(F.concat_ws(".", F.substring("source", F.lit(7), F.length("source")), "source_column").alias("origin"), F.col("source").alias("node"), F.col("source_column").alias("col"))
    return reached(edges, seeds.distinct())
