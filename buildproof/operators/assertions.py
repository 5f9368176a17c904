"""Data assertions as lazy operators: a build in, the numbers or rows a decision needs out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_count() -> Column:
    return F.count(F.lit(1))


def null_count(column: str) -> Column:
    return F.count_if(named(column).isNull())


def blank_count(column: str) -> Column:
    """Values that are empty or only spaces."""
    return F.count_if(F.trim(named(column)) == "")


def negative_count(column: str) -> Column:
    return F.count_if(named(column) < 0)


def outside_domain(df: DataFrame, column: str, allowed: Sequence) -> Column:
    """Count of values that are not null and not allowed.

    Allowed values take the column's type; one that can't never matches. A null among them leaves every comparison
    open, as NOT IN does, so that nothing counts.
    """
    if None in allowed:
        return F.count_if(F.lit(False))
    if not allowed:
        return F.count(named(column))
    kind = df.schema[column].dataType.simpleString()
    literals = [F.lit(str(a) if kind == "string" else a).try_cast(kind) for a in allowed]
    return F.count_if(named(column).isNotNull() & ~F.coalesce(named(column).isin(*literals), F.lit(False)))


def outside_range(column: str, low=None, high=None) -> Column:
    """Count of values below low or above high; both bounds belong to the range, and null is no violation."""
    found = F.lit(False)
    if low is not None:
        found = found | (named(column) < low)
    if high is not None:
        found = found | (named(column) > high)
    return F.count_if(found)


def fused(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """All scalar metrics of a build in one pass over it."""
    return df.agg(*[c.alias(name) for name, c in metrics.items()])


def per_column(df: DataFrame, columns: Sequence[str], metric, name: str) -> DataFrame:
    """col_name, total, <name> and rate of a metric for several columns, from one pass."""
    one = df.agg(row_count().alias("total"), *[metric(c).alias(f"m{k}") for k, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"m{k}").alias(name)) for k, c in enumerate(columns)]))
    found = one.select("total", rows.alias("x")).select("x.col_name", "total", f"x.{name}")
    return found.withColumn("rate", F.when(F.col("total") > 0, F.col(name) / F.col("total")))


def duplicate_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key groups with more than one row; nulls form groups of their own."""
    return df.groupBy(*[named(k) for k in key]).agg(row_count().alias("dup_count")).filter("dup_count > 1")


def duplicate_summary(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return duplicate_groups(df, key).agg(row_count().alias("dup_groups"), F.coalesce(F.max("dup_count"), F.lit(0)).alias("max_dup"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole rows that occur more than once."""
    return duplicate_groups(df, df.columns)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(named(column)).alias("distinct_count"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child with a key that no row of parent has; null keys aren't orphans. The planner picks the join by measured size."""
    keys = parent.select(named(parent_key).alias("__parent")).filter("__parent is not null").distinct()
    return child.filter(named(key).isNotNull()).join(keys, named(key) == F.col("__parent"), "left_anti")


def freshness(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """The greatest timestamp, and its age in hours at a given moment."""
    found = df.agg(F.max(named(column).cast("timestamp_ntz")).alias("max_ts"))
    return found.select("max_ts", F.expr(f"timestampdiff(MICROSECOND, max_ts, timestamp_ntz'{as_of}') / 3.6e9D").alias("age_hours"))


def reconcile(metric: DataFrame, truth: DataFrame, tolerance_abs: float = 0.0, tolerance_pct: float = 0.0) -> DataFrame:
    """The first column of two one-row results side by side, and whether they agree within the wider tolerance."""
    one = lambda df, name: df.select(F.lit(1).alias("one"), F.col(f"`{df.columns[0]}`").cast("double").alias(name))
    both = one(metric, "metric").join(one(truth, "truth"), "one")
    gap = F.abs(F.col("metric") - F.col("truth"))
    return both.select("metric", "truth", gap.alias("gap"), (gap <= F.greatest(F.lit(tolerance_abs), F.abs("truth") * tolerance_pct)).alias("agrees"))
