"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, stage

MAX_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Root (the smallest node) of every node that has an edge. edges: u long, v long. Returns node, root.

    Every round links each node's larger neighbours, then its smaller ones, to the least node it knows.
    Minima are partial aggregates and the joins can be split, so a hub may hold a third of all edges.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(small_min, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stage(small.union(small_min.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        before, seen = seen, _print(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._stage_path = now._stage_path  # what it reads
    return out
