"""The scalar checks on a stream: the same metric columns, per window of event time. An extra beyond the batch checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, metrics: Mapping[str, Column], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """One row per window with all metrics; rows later than `late` behind the newest are dropped, so state stays bounded."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.window("__ts", width).alias("w")).agg(*[c.alias(k) for k, c in metrics.items()])
    return found.select(F.col("w.start").alias("window_start"), *metrics)
