"""Checks that keep state over a stream: repeated keys, orphans of a changing parent, drift between windows, a verdict for every batch.

All state is bounded by a watermark: what is later than it allows is dropped, and whatever it has passed is final and forgotten.
On the rows that are not dropped, each gives what its batch form gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checks.registry import Context
from ..checks.runner import Spec, run_checks
from ..operators.assertions import named
from .metrics import windowed

TIME = "__ts"


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """The rows with their time, and, of a stream, how late they may be. Rows without a time belong to no window."""
    rows = df.withColumn(TIME, named(ts).cast("timestamp")).filter(F.col(TIME).isNotNull())
    return rows.withWatermark(TIME, late) if df.isStreaming else rows


def duplicate_keys(df: DataFrame, keys: Sequence[str], ts: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, keys, dup_count of the keys that stand more than once in a window (D-GRAIN-001). One state entry for each key and open window."""
    groups = timed(df, ts, late).groupBy(F.window(TIME, width).alias("w"), *[named(k) for k in keys])
    found = groups.agg(F.count(F.lit(1)).alias("dup_count")).filter("dup_count > 1")
    return found.select(F.col("w.start").alias("window_start"), *[named(k) for k in keys], "dup_count")


def orphans(child: DataFrame, fk: str, child_ts: str, parent: DataFrame, key: str, parent_ts: str, before: str = "1 day", after: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Rows of child (with a key) that no parent row came for from `before` their time until `after` it (D-RI-001).

    The parent may be a stream of its own. A child is held until the watermarks of both say that no parent can come any more.
    """
    c = timed(child.filter(named(fk).isNotNull()), child_ts, late).withColumn("__fk", named(fk))
    p = timed(parent, parent_ts, late).select(named(key).alias("__key"), F.col(TIME).alias("__seen"))
    near = F.expr(f"__key = __fk AND __seen >= {TIME} - INTERVAL {before} AND __seen <= {TIME} + INTERVAL {after}")
    return c.join(p, near, "left_outer").filter("__key is null").drop("__fk", "__key", "__seen", TIME)


def drift(metrics: DataFrame, names: Sequence[str], tolerance: float) -> DataFrame:
    """window_start, metric, before, now, diff of the metrics of windows that moved by more than the tolerance from the window before.

    metrics: the rows of windowed(), of all windows so far; there is one row for each window, however many events it had.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), named(n).cast("double").alias("now")) for n in names])
    long = metrics.select("window_start", F.explode(entries).alias("x")).select("window_start", "x.*")
    last = Window.partitionBy("metric").orderBy("window_start")
    moved = long.withColumn("before", F.lag("now").over(last)).filter("before is not null and now is not null")
    diff = F.abs(F.col("now") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-9))
    return moved.withColumn("diff", diff).filter(F.col("diff") > tolerance).select("window_start", "metric", "before", "now", "diff")


def metrics_to(stream: DataFrame, ts: str, metrics: Mapping[str, Column], path: str, checkpoint: str, width: str = "1 day", late: str = "2 days") -> StreamingQuery:
    """Add the metrics of every window to a table once the window is final, so that drift() can be asked at any time."""
    return windowed(stream, ts, metrics, width, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts_to(stream: DataFrame, specs: Sequence[Spec], path: str, checkpoint: str, context: Callable[[DataFrame], Context] = Context, **trigger) -> StreamingQuery:
    """Run checks on every batch, and keep its verdict and results under batch=<number>.

    A batch that is run again after a failure writes over its own folder, so that each counts once.
    """

    def judge(batch: DataFrame, number: int) -> None:
        run = run_checks(context(batch), specs)
        rows = [(number, run.verdict, r.id, r.status, r.severity, r.observed) for r in run.results]
        kept = batch.sparkSession.createDataFrame(rows, "number long, verdict string, check string, status string, severity string, observed string")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replayed(stream: DataFrame, name: str, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stateful query gives once its stream has ended: run to the end into the shared folder, and read back."""
    from ..sources.scratch import new_folder

    spark, made = stream.sparkSession, make(stream)
    path = new_folder(spark, name)
    query = made.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/rows")
