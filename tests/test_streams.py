"""Checks with state, against the same checks on the rows of a replay that were not too late."""

import time

from pyspark.sql import functions as F

from buildproof.checks.runner import Spec
from buildproof.operators import assertions as A
from buildproof.streaming import checks as S
from buildproof.streaming.metrics import windowed

KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def replay(spark, sf_dir, folder):
    """The events in six files in the order of time, but every fiftieth in the last one, however old; a stream of a file at a time, and the rows with their file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    bounds = [r.b for r in events.selectExpr("percentile_approx(ts, array(0.2, 0.4, 0.6, 0.8)) AS b").collect()][0]
    part = sum(((F.col("ts") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    rows = events.withColumn("part", F.when(F.col("event_id") % 50 == 0, 5).otherwise(part))
    for k in range(6):
        rows.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, rows


def test_state_gives_what_a_batch_gives(spark, sf_dir, tmp_path):
    """A late row counts as long as its window is not final: until two days after its end were seen, by the batch before the last one."""
    stream, rows = replay(spark, sf_dir, str(tmp_path / "events"))
    end_of = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    final = lambda top: F.lit(top) - F.expr("INTERVAL 2 DAYS")
    before = rows.filter("part < 4").agg(F.max("ts")).first()[0]
    kept = rows.filter((F.col("part") < 5) | (end_of > final(before))).cache()
    assert 0 < kept.filter("part = 5").count() < rows.filter("part = 5").count()  # some are late, some too late
    made = S.replayed(stream, "dup", lambda s: S.duplicate_keys(s, ["user_id"], "ts", "1 hour", "2 days"))
    got = {(r.window_start, r.user_id, r.dup_count) for r in made.collect()}
    done = kept.filter(end_of <= final(rows.agg(F.max("ts")).first()[0]))
    want = {(r.window_start, r.user_id, r.dup_count) for r in S.duplicate_keys(done, ["user_id"], "ts", "1 hour").collect()}
    assert want and got == want


def test_orphans_of_a_parent_that_changes(spark, tmp_path):
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    child = [(1, "a", at(1, 5)), (2, "b", at(1, 5)), (3, "c", at(2, 5)), (4, None, at(2, 5)), (5, "a", at(3, 5)), (6, "d", at(20, 0))]
    parent = [("a", at(1, 4)), ("b", at(1, 9)), ("c", at(2, 6)), ("a", at(3, 3)), ("z", at(20, 0))]
    spark.createDataFrame(child, "id long, fk string, t string").selectExpr("id", "fk", "cast(t AS timestamp_ntz) t").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame(parent, "k string, t string").selectExpr("k", "cast(t AS timestamp_ntz) t").write.parquet(str(tmp_path / "p"))
    streams = [spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in (("c", "id long, fk string, t timestamp_ntz"), ("p", "k string, t timestamp_ntz"))]
    made = S.replayed(streams[0], "orphans", lambda _: S.orphans(streams[0], "fk", "t", streams[1], "k", "t", "1 DAY", "1 HOUR", "1 day"))
    assert [r.id for r in made.collect()] == [2]  # b's parent came too late; 4 has no key; 6 isn't final
    tables = [spark.read.parquet(str(tmp_path / n)) for n in "cp"]
    assert sorted(r.id for r in S.orphans(tables[0], "fk", "t", tables[1], "k", "t", "1 DAY", "1 HOUR").collect()) == [2, 6]


def test_drift_between_windows(spark, sf_dir, tmp_path):
    stream = spark.readStream.schema(KIND).parquet(f"{sf_dir}/events*.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    shifted = lambda df: df.withColumn("value", F.when(F.col("ts") >= "2024-01-15", F.col("value") * 3).otherwise(F.col("value")))
    metrics = {"n": A.row_count(), "mean": F.avg("value")}
    path, state = str(tmp_path / "m"), str(tmp_path / "c")
    S.metrics_to(shifted(stream), "ts", metrics, path, state, "5 days", "1 day").awaitTermination()
    got = S.drift(spark.read.parquet(path), ["mean"], 0.5).collect()
    batch = windowed(shifted(events), "ts", metrics, "5 days")
    last = spark.read.parquet(path).agg(F.max("window_start")).first()[0]
    want = S.drift(batch.filter(F.col("window_start") <= last), ["mean"], 0.5).collect()
    assert [(r.window_start, r.metric, round(r.now, 6)) for r in got] == [(r.window_start, r.metric, round(r.now, 6)) for r in want] and got


def test_a_verdict_for_every_batch(spark, tmp_path):
    for k, rows in enumerate(([1, 2], [3, 3], [4])):
        spark.createDataFrame([(x,) for x in rows], "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.verdicts_to(stream, [Spec("D-GRAIN-001", {"key": ["k"]}), Spec("D-GRAIN-002", {"min_rows": 1})], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.verdict for r in found.select("batch", "verdict").distinct().collect()) == ["BLOCKED", "READY", "READY"] and found.count() == 6
    S.verdicts_to(stream, [Spec("D-GRAIN-001", {"key": ["k"]})], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6  # nothing new, nothing twice
