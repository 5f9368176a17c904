"""Evidence that is the same in every run: the rows of least hash, taken in the job that counts all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from .assertions import named
from .hashtree import hashable


def content_hash(df: DataFrame) -> Column:
    """A hash of a whole row, which neither the order of rows nor their partitions change."""
    return F.xxhash64(F.lit(7), *[hashable(df, c) for c in df.columns])


def bottom_k(df: DataFrame, k: int, first: Sequence[Column] = (), by: Column | None = None, per: Sequence[str] = ()) -> DataFrame:
    """At most k rows, or k of each key in `per`: those that `first` puts first and, among equals, of least `by` (a hash of the row unless told otherwise).

    Every task keeps k rows (of each key) and passes no more on, so that a key with most of all rows is no burden.
    """
    order = [*first, content_hash(df) if by is None else by]
    if not per:
        return df.orderBy(*order).limit(k)
    window = Window.partitionBy(*[named(c) for c in per]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= k).drop("__rank")


def counted(df: DataFrame, k: int, first: Sequence[Column] = (), show=lambda some: some) -> tuple[int, list[Row]]:
    """(how many rows there are, bottom_k() of them as show() gives them) from one job, in which the count is observed below the sort."""
    if k <= 0:
        return df.count(), []
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and int(most.get()) <= k:  # no limit is left in the plan, and a sort alone may read its input twice
        rows = show(bottom_k(df, k, first)).collect()
        return len(rows), rows
    seen = Observation()
    rows = show(bottom_k(df.observe(seen, F.count(F.lit(1)).alias("n")), k, first)).collect()
    if len(rows) < k:  # all of them; an empty plan reports nothing
        return len(rows), rows
    return seen.get["n"], rows
