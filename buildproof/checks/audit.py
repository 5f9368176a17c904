"""One line per run in a log, and the log as a table: what was found when, and how it moves."""

from __future__ import annotations

import getpass
import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runner import Run

SCHEMA = "run_id string, at timestamp, user string, target string, source string, ruleset string, profile string, verdict string, failed long, errors long"


def record(run: Run, target: str, source: str = "", ruleset: str = "", profile: str = "", user: str | None = None) -> dict[str, object]:
    try:
        who = user or getpass.getuser()
    except (OSError, KeyError):  # no name for this account
        who = "unknown"
    return {"run_id": uuid.uuid4().hex, "at": datetime.now(timezone.utc).isoformat(), "user": who, "target": target, "source": source, "ruleset": ruleset, "profile": profile, "verdict": run.verdict, "failed": run.summary["fail"], "errors": run.summary["error"]}


def append(path: str | Path, entry: dict[str, object]) -> None:
    """Add a line to a log; what is in it is never rewritten."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as log:
        log.write(json.dumps(entry, default=str) + "\n")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of one log or of a folder of logs; lines that are none are left out."""
    return spark.read.schema(SCHEMA).json(path).filter("run_id is not null")


def page(runs: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The newest runs, or those that follow (at, run_id) of the last one seen."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        runs = runs.filter((F.col("at") < at) | ((F.col("at") == at) & (F.col("run_id") > last)))
    return runs.orderBy(F.desc("at"), "run_id").limit(size)


def trend(runs: DataFrame, last: int = 20) -> DataFrame:
    """The last runs of every target, each with the verdict before it and whether that changed."""
    newest = Window.partitionBy("target").orderBy(F.desc("at"), "run_id")
    ranked = runs.withColumn("before", F.lead("verdict").over(newest)).withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= last)
    return ranked.select("target", "n", "at", "verdict", "before", (F.col("before").isNotNull() & (F.col("before") != F.col("verdict"))).alias("changed"))
