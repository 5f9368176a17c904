"""Bounds on what a run may take: rows handed over, a name for its jobs, and time."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


class TimedOut(RuntimeError):
    """The jobs took longer than they may."""


def read_capped(df: DataFrame, cap: int) -> tuple[list[Row], bool]:
    """At most cap rows of a result, and whether there are more."""
    if cap <= 0:
        raise ValueError("the cap must be positive")
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap


@contextmanager
def limited(spark: SparkSession, tag: str, seconds: float | None = None) -> Iterator[None]:
    """Jobs started inside carry the tag; those still running when time is up are cancelled, and TimedOut is raised."""
    context, late = spark.sparkContext, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds else None
    context.addJobTag(tag)
    try:
        if timer:
            timer.start()
        yield
    except Exception as error:
        if late.is_set():
            raise TimedOut(f"{tag} took more than {seconds} s") from error
        raise
    finally:
        context.removeJobTag(tag)
        if timer:
            timer.cancel()
