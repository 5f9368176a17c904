"""Fan-out of every join: rows in and out as measured, and the key that multiplies rows most."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalyst import items, kind

#: Keys that the sketch of a side keeps at most; a key with over 1 / TRACKED of a side's rows is surely among them.
TRACKED = 10_000
_COUNTS = ("numOutputRows", "shuffleRecordsWritten")


@dataclass(frozen=True)
class Join:
    """how: kind of join; on: its condition; left, right, out: rows. key, times: the heaviest key of the side that multiplies, and about how many rows it has there."""

    how: str
    on: str
    left: int
    right: int
    out: int
    key: str | None = None
    times: int | None = None

    @property
    def growth(self) -> float:
        """Rows out for each row of the larger side."""
        return self.out / max(self.left, self.right, 1)


def _below(node) -> list:
    """Nodes below one, through what adaptive execution wraps them in."""
    name = kind(node)
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    if name == "ReusedExchangeExec":
        return [node.child()]
    return items(node.children())


def _rows(node) -> int:
    """Rows that a node hands on: its own count, or that of the nearest node below that has one."""
    while True:
        metrics = node.metrics()
        for name in _COUNTS:
            if metrics.contains(name) and not kind(node).startswith("AQEShuffleRead"):
                return metrics.get(name).get().value()
        below = _below(node)
        if len(below) != 1:
            return 0
        node = below[0]


def _join_nodes(df: DataFrame) -> list:
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if kind(node) in ("SortMergeJoinExec", "BroadcastHashJoinExec", "ShuffledHashJoinExec", "BroadcastNestedLoopJoinExec", "CartesianProductExec"):
            found.append(node)
        stack += _below(node)
    return found


def _heaviest(df: DataFrame, plan, keys: list) -> tuple[str, int] | None:
    """The most frequent key of one side of a join, by a sketch of bounded size that tasks merge."""
    spark = df.sparkSession
    classic = spark._jvm.org.apache.spark.sql.classic
    side = classic.Dataset.ofRows(spark._jsparkSession, plan)
    columns = [classic.ExpressionUtils.column(k) for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    chosen = DataFrame(side.select(spark._jvm.PythonUtils.toSeq([c.alias(n) for c, n in zip(columns, names)])), spark)
    text = F.concat_ws(", ", *[F.col(n).cast("string") for n in names])
    known = chosen.filter(" AND ".join(f"{n} IS NOT NULL" for n in names)).select(text.alias("key"))
    top = known.agg(F.expr(f"approx_top_k(key, 1, {TRACKED})").alias("top")).first().top
    return (top[0]["item"], top[0]["count"]) if top else None


def joins(df: DataFrame, blow_up: float = 10.0) -> list[Join]:
    """The joins of a build that has run (see performance.measured), the one that multiplies rows most first. Of those that grow by blow_up or more, the heaviest key as well."""
    out = []
    for node in _join_nodes(df):
        sides = items(node.children())
        name = kind(node)
        keyed = hasattr(node, "leftKeys") and name in ("SortMergeJoinExec", "BroadcastHashJoinExec", "ShuffledHashJoinExec")
        keys = [items(node.leftKeys()), items(node.rightKeys())] if keyed else [[], []]
        said = " AND ".join(f"{a.sql()} = {b.sql()}" for a, b in zip(*keys))
        rows = [_rows(s) for s in sides]
        made = Join(node.joinType().toString() if name != "CartesianProductExec" else "Cross", said, *rows, _rows(node))
        link = node.logicalLink()
        if made.growth >= blow_up and said and not link.isEmpty() and kind(link.get()) == "Join":
            # rows of the larger side are multiplied by keys that repeat on the other
            other = 1 if rows[0] >= rows[1] else 0
            heavy = _heaviest(df, (link.get().left(), link.get().right())[other], keys[other])
            if heavy:
                made = replace(made, key=heavy[0], times=heavy[1])
        out.append(made)
    return sorted(out, key=lambda j: -j.growth)
