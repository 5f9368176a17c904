"""Migration parity: measure an object once, compare measurements of both sides as joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .assertions import named
from .regression import exact_sum, no_numbers

NULL_MARK = "∅"
EPSILON = 1e-9
#: A difference of texts of digits is never less than this.
LEAST = 1e-38


def type_category(kind: T.DataType) -> str:
    """Changes within a category are allowed in a migration."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date-time"
    return "boolean" if isinstance(kind, T.BooleanType) else "other"


def relative_difference(new: Column, old: Column) -> Column:
    """|new - old| / |old|; zero for equal values, even of zero."""
    return F.when(new == old, F.lit(0.0)).otherwise(F.abs(new - old) / F.greatest(F.abs(old), F.lit(EPSILON)))


def renamed(df: DataFrame, legacy_names: Mapping[str, str]) -> DataFrame:
    """Columns under the names they had before the migration. legacy_names: new name -> old name."""
    return df.withColumnsRenamed(dict(legacy_names))


def spelled(names: Iterable[str], columns: Sequence[str]) -> list[str]:
    """The names as `columns` spells them; one that it lacks, or has in two spellings, stays as it is."""
    known: dict[str, list[str]] = {}
    for c in columns:
        known.setdefault(c.upper(), []).append(c)
    return [n if n in columns else known[n.upper()][0] if len(known.get(n.upper(), ())) == 1 else n for n in names]


def respelled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with its columns under the spelling of `columns` where they differ by case alone, as they do after most migrations."""
    return df.toDF(*spelled(df.columns, columns))


def key_text(df: DataFrame, column: str) -> Column:
    """A value as text that doesn't depend on its numeric type: integral numbers without a point, null as a mark."""
    c, kind = named(column), df.schema[column].dataType
    text = c.cast("string")
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.IntegralType):
        text = F.when((c % 1 == 0) & (F.abs(c) < 1e37), c.cast("decimal(38,0)").cast("string")).otherwise(text)
    if type_category(kind) == "text":  # a value that begins with the mark is told apart from null
        text = F.when(F.startswith(text, F.lit(NULL_MARK)), F.concat(F.lit(NULL_MARK), text)).otherwise(text)
    return F.coalesce(text, F.lit(NULL_MARK))


#: What a sum, minimum or maximum of these is, to the last digit.
EXACT = "decimal(38,{0})"


def _exactly(df: DataFrame, name: str) -> dict[str, Column]:
    """Sum, minimum and maximum of an integer or decimal column as text, which keeps the digits that a double loses; none of other columns."""
    kind, c = df.schema[name].dataType, named(name)
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType):
        exact = EXACT.format(getattr(kind, "scale", 0))
        return {"sum": F.try_sum(c.cast(exact)).cast("string"), "min": F.min(c).cast("string"), "max": F.max(c).cast("string")}
    return {}


def measure(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """kind, col_name, value, exact: rows; per column nulls; per numeric column sum, min, max and, for floats, NaN and infinities; per key distinct values.

    value is a double; exact, where a column's type has more digits than that, the same as text. All but the
    distinct values come from one scan, a row a task; those of all keys from a second one of the key columns alone, expanded to (key, value) and counted in two levels, so
    that no other metric is carried through their shuffle.
    """
    made: list[tuple[str, str, Column, Column | None]] = [("row_count", "", F.count(F.lit(1)), None)]
    for f in df.schema:
        made.append(("null_count", f.name, F.count_if(named(f.name).isNull()), None))
        if isinstance(f.dataType, T.NumericType):
            exact = _exactly(df, f.name)
            made += [(kind, f.name, c, exact.get(kind)) for kind, c in (("sum", exact_sum(df, f.name)), ("min", F.min(named(f.name))), ("max", F.max(named(f.name))))]
            made += [(kind, f.name, c, None) for kind, c in no_numbers(df, f.name).items()]
    columns = [c for k, (_, _, value, exact) in enumerate(made) for c in (value.cast("double").alias(f"m{k}"), (F.lit(None).cast("string") if exact is None else exact).alias(f"x{k}"))]
    one = df.agg(*columns)
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("col_name"), F.col(f"m{k}").alias("value"), F.col(f"x{k}").alias("exact")) for k, (kind, name, _, _) in enumerate(made)])
    out = one.select(F.explode(rows).alias("x")).select("x.*")
    if not keys:
        return out
    c_kind = {k: df.schema[k].dataType for k in keys}
    floating = lambda k: isinstance(c_kind[k], (T.FloatType, T.DoubleType))
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), (named(k) + 0.0 if floating(k) else named(k)).cast("string").alias("v")) for i, k in enumerate(keys)])
    counts = df.select(F.explode(each).alias("x")).select("x.*").filter("v is not null").distinct().groupBy("id").count()
    of = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("id") + 1).cast("int"))
    found = df.sparkSession.range(len(keys)).join(counts, "id", "left")
    return out.union(found.select(F.lit("distinct").alias("kind"), of.alias("col_name"), F.coalesce("count", F.lit(0)).cast("double").alias("value"), F.lit(None).cast("string").alias("exact")))


def compare_metrics(old: DataFrame, new: DataFrame, kinds: Sequence[str], tolerance: float) -> DataFrame:
    """kind, col_name, old_value, new_value, diff of metrics of both sides; breach tells what exceeds the tolerance. Unmeasured ones are left out.

    Columns are the same whatever the case of their names. Where both sides know all digits, the difference is that of all digits.
    """
    exact = lambda df: F.col("exact") if "exact" in df.columns else F.lit(None).cast("string")
    left = old.filter(F.col("kind").isin(*kinds)).select("kind", "col_name", F.upper("col_name").alias("_name"), F.col("value").alias("old_value"), exact(old).alias("_old"))
    right = new.select("kind", F.upper("col_name").alias("_name"), F.col("value").alias("new_value"), exact(new).alias("_new"))
    both = left.join(right, ["kind", "_name"]).filter("old_value is not null and new_value is not null")
    gaps = [F.abs(F.col("_new").try_cast(EXACT.format(s)) - F.col("_old").try_cast(EXACT.format(s))).cast("double") for s in (30, 20, 10, 0)]  # as many digits as both have room for
    by_digits = F.greatest(F.coalesce(*gaps), F.lit(LEAST)) / F.greatest(F.abs(F.col("old_value")), F.lit(EPSILON))
    diff = F.when(F.col("_old") == F.col("_new"), F.lit(0.0)).when(F.coalesce(*gaps).isNotNull(), by_digits).otherwise(relative_difference(F.col("new_value"), F.col("old_value")))
    return both.select("kind", "col_name", "old_value", "new_value", diff.alias("diff")).withColumn("breach", F.col("diff") > tolerance)


def compare_nulls(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """Like compare_metrics() for null counts, with the difference as a share of the old rows."""
    rows = old.filter("kind = 'row_count'").select(F.greatest("value", F.lit(1.0)).alias("rows"), F.lit("null_count").alias("kind"))
    both = compare_metrics(old, new, ["null_count"], tolerance).drop("diff", "breach").join(rows, "kind")
    diff = F.abs(F.col("new_value") - F.col("old_value")) / F.col("rows")
    return both.withColumn("diff", diff).withColumn("breach", F.col("diff") > tolerance).drop("rows")


def compare_schemas(old: DataFrame, new: DataFrame) -> list[tuple[str, str]]:
    """(column, what is wrong) of legacy columns that are missing or changed category; further target columns are no fault."""
    target = {f.name.upper(): f.dataType for f in new.schema}
    out = []
    for f in old.schema:
        kind = target.get(f.name.upper())
        if kind is None:
            out.append((f.name, "missing"))
        elif type_category(kind) != type_category(f.dataType):
            out.append((f.name, f"{type_category(f.dataType)} became {type_category(kind)}"))
    return out


def schema_losses(old: DataFrame, new: DataFrame) -> DataFrame:
    """col_name, state, n_values: the legacy columns at fault and the values in each that are at stake, counted in one pass over the legacy rows."""
    wrong = compare_schemas(old, new)
    if not wrong:
        return old.limit(0).select(F.lit("").alias("col_name"), F.lit("").alias("state"), F.lit(0).cast("long").alias("n_values"))
    one = old.agg(*[F.count(named(c)).alias(f"m{k}") for k, (c, _) in enumerate(wrong)])
    rows = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(w).alias("state"), F.col(f"m{k}").alias("n_values")) for k, (c, w) in enumerate(wrong)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def grain_groups(df: DataFrame, grain: Sequence[str], top: int | None = None) -> DataFrame:
    """Groups and their row counts, all of them or the largest few."""
    found = df.select(*[key_text(df, g).alias(g) for g in grain]).groupBy(*grain).agg(F.count(F.lit(1)).alias("group_count"))
    return found if top is None else found.orderBy(F.desc("group_count"), *grain).limit(top)


def compare_grain(old: DataFrame, new: DataFrame, grain: Sequence[str], tolerance: float) -> DataFrame:
    """Groups that are missing, extra, or whose counts differ by more than the tolerance."""
    a, b = old.withColumnRenamed("group_count", "old_count"), new.withColumnRenamed("group_count", "new_count")
    both = a.join(b, list(grain), "full_outer")
    diff = relative_difference(F.col("new_count"), F.col("old_count"))
    state = F.when(F.col("new_count").isNull(), "missing").when(F.col("old_count").isNull(), "extra").when(diff > tolerance, "mismatch")
    return both.withColumn("state", state).filter("state is not null")


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash that tells nulls from values and moved values from kept ones, the same for all types of a category."""
    parts: list[Column] = []
    for name in sorted(columns, key=lambda c: (c.upper(), c)):
        kind, c = df.schema[name].dataType, named(name)
        if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
            c = c.cast("decimal(38,0)").cast("string")
        elif isinstance(kind, T.NumericType):
            c = c.cast("double")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("timestamp_ntz").cast("string")
        elif type_category(kind) == "text":
            c = c.cast("string")
        elif not isinstance(kind, T.BooleanType):
            c = F.to_json(F.struct(c.alias("v")))
        parts += [named(name).isNull(), c]
    return F.xxhash64(*parts)


def hashed_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The keys as text and the hash of every row."""
    return df.select(*[key_text(df, k).alias(k) for k in keys], row_hash(df, columns or df.columns).alias("row_hash"))


def repeated_keys(hashed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of hashed rows that stand there more than once."""
    return hashed.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of hashed rows that differ or stand on one side only, with the state: one signed union and two groupings; no pairs are made."""
    names = [named(k) for k in keys]
    a, b = (df.withColumn("__side", F.lit(side)) for df, side in ((old, 1), (new, -1)))
    left = a.unionByName(b).groupBy(*names, "row_hash").agg(F.sum("__side").alias("n")).filter("n <> 0")
    both = left.groupBy(*names).agg(F.max("n").alias("most"), F.min("n").alias("least"))
    state = F.when((F.col("most") > 0) & (F.col("least") < 0), "mismatch").when(F.col("most") > 0, "missing").otherwise("extra")
    return both.select(*names, state.alias("state"))


def compare_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ or stand on one side only; all rows are compared, not a window of them. Names may differ in case.

    Rows of a key that repeats are compared as a whole: what one side has more often is missing or extra, or a
    mismatch if each side has rows that the other lacks.
    """
    new, keys = respelled(new, old.columns), spelled(keys, old.columns)
    columns = [c for c in old.columns if c in new.columns]
    return changed_keys(hashed_rows(old, keys, columns), hashed_rows(new, keys, columns), keys)
