"""A build against its baseline: fingerprints and whole multisets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, MapType, NumericType

from .assertions import named

ROW_COUNT = "__row_count"


#: Digits after the point that doubles are summed with, and the power of ten that brings up what is left below them.
DIGITS, LIFT = 12, 1e26
#: Sums of doubles from here on don't fit into decimals; they are plain, depend on the order of rows, and are compared with this slack.
LARGE, SLACK = 1e25, 1e-9


def exact_sum(df: DataFrame, column: str):
    """A sum that doesn't depend on the order of rows: integers and decimals exactly, doubles as two decimals.

    The first holds 12 digits after the point, the second what a double has below them, down to 1e-38. What is not a
    number, or infinite, is left out. If the values are too large for that, it is the plain sum of doubles.
    """
    kind, c = df.schema[column].dataType, named(column)
    if isinstance(kind, (IntegralType, DecimalType)):
        return F.sum(c.cast(DecimalType(38, getattr(kind, "scale", 0)))).cast("double")
    c = c.cast("double")
    c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    target = DecimalType(38, DIGITS).simpleString()
    high = c.try_cast(target)
    low = ((c - high.cast("double")) * LIFT).try_cast(target)
    exact = F.try_sum(high).cast("double") + F.try_sum(low).cast("double") / LIFT
    return F.when((F.count(c) == F.count(low)) & exact.isNotNull(), exact).otherwise(F.sum(c))


def no_numbers(df: DataFrame, column: str) -> dict[str, Column]:
    """Counts of NaN and of both infinities of a column of floats, which its sum leaves out; none of other columns."""
    kind = df.schema[column].dataType
    if not isinstance(kind, FractionalType) or isinstance(kind, DecimalType):
        return {}
    c = named(column).cast("double")
    return {"nan": F.count_if(F.isnan(c)), "inf": F.count_if(c == float("inf")), "-inf": F.count_if(c == float("-inf"))}


def fingerprint(df: DataFrame, irregular: bool = False) -> DataFrame:
    """name, value: the number of rows, and the sum and count of every numeric column, from one pass.

    irregular: how many values are NaN or infinite as well, as the sums leave them out while the counts don't.
    """
    made = {ROW_COUNT: F.count(F.lit(1)).cast("double")}
    for f in df.schema:
        if isinstance(f.dataType, NumericType):
            made |= {f"sum:{f.name}": F.coalesce(exact_sum(df, f.name), F.lit(0.0)), f"count:{f.name}": F.count(named(f.name)).cast("double")}
            if irregular:
                made |= {f"{what}:{f.name}": c.cast("double") for what, c in no_numbers(df, f.name).items()}
    one = df.agg(*[v.alias(f"m{k}") for k, v in enumerate(made.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"m{k}").alias("value")) for k, name in enumerate(made)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def fingerprint_breaches(current: DataFrame, baseline: DataFrame, tolerance_pct: float = 0.0) -> DataFrame:
    """Fingerprint entries of the baseline that the current build lacks or misses by more than the tolerance."""
    now = current.select("name", F.col("value").alias("current"))
    both = baseline.select("name", F.col("value").alias("baseline")).join(now, "name", "left")
    slack = F.when(F.abs("baseline") >= LARGE, F.lit(max(tolerance_pct, SLACK))).otherwise(F.lit(float(tolerance_pct)))
    return both.filter(F.col("current").isNull() | (F.abs(F.col("current") - F.col("baseline")) > F.abs("baseline") * slack))


def _comparable(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.array_sort(F.map_entries(named(c))).alias(c) if isinstance(df.schema[c].dataType, MapType) else named(c) for c in columns])


def _shared(current: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns they share, without regard to case, under the names of current."""
    named = {c.upper(): c for c in baseline.columns}
    columns = [c for c in current.columns if c.upper() in named]
    other = _comparable(baseline, [named[c.upper()] for c in columns])
    return _comparable(current, columns), other.toDF(*columns)


def added_rows(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows that current has more often than baseline, as often as that."""
    now, before = _shared(current, baseline)
    return now.exceptAll(before)


def removed_rows(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return added_rows(baseline, current)


def row_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows of either side that the other has less often: __change (added or removed), __times, and the row. One shuffle."""
    now, before = _shared(current, baseline)
    columns = now.columns
    signed = now.withColumn("__n", F.lit(1)).unionByName(before.withColumn("__n", F.lit(-1)))
    found = signed.groupBy(*[named(c) for c in columns]).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return found.select(F.when(F.col("__n") > 0, "added").otherwise("removed").alias("__change"), F.abs("__n").alias("__times"), *[named(c) for c in columns])


def schema_changes(current: DataFrame, baseline: DataFrame) -> tuple[list[str], list[str]]:
    """(columns added, columns removed), without regard to case."""
    a, b = ({c.upper() for c in df.columns} for df in (current, baseline))
    return sorted(a - b), sorted(b - a)


def kind_changes(current: DataFrame, baseline: DataFrame) -> list[str]:
    """Shared columns that are numeric on one side only: a side lacks their sums, even if their values read the same."""
    a, b = ({f.name.upper(): isinstance(f.dataType, NumericType) for f in df.schema} for df in (current, baseline))
    return sorted(c for c in a if c in b and a[c] != b[c])
