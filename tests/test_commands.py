"""Commands for rules, baselines and parity, and estates whose workbooks run at once."""

import json
import threading
import time

from pyspark.sql import functions as F

from buildproof.checks.estate import estate_of, job_tag, run_estate
from buildproof.checks.registry import CHECKS, PARAM_KINDS, catalogue
from buildproof.cli import main
from buildproof.sources.baseline import BaselineStore

from .test_runs import _workbook


def test_rules_samples_and_the_catalogue(tmp_path, capsys):
    pin = ["--pin", str(tmp_path / "pin")]
    assert main(["rules", "show", *pin]) == 0 and "no version" in capsys.readouterr().out
    assert main(["rules", "pin", "2024.1", *pin]) == 0 and main(["rules", "show", *pin]) == 0 and "2024.1" in capsys.readouterr().out
    assert main(["rules", "pin", "a b", *pin]) == 3
    assert main(["init", str(tmp_path / "new")]) == 0 and "ruleset.yml" in capsys.readouterr().out
    (tmp_path / "new" / "map.yml").write_text("kept")
    assert main(["init", str(tmp_path / "new")]) == 0 and (tmp_path / "new" / "map.yml").read_text() == "kept"
    (tmp_path / "new" / "map.yml").unlink()
    assert main(["rules", "pull", str(tmp_path / "new"), str(tmp_path / "here")]) == 0 and (tmp_path / "here" / "ruleset.yml").exists()
    assert main(["rules", "pull", str(tmp_path / "none"), str(tmp_path / "here")]) == 3
    capsys.readouterr()
    assert main(["list", "--format", "json"]) == 0
    told = {c["id"]: c for c in json.loads(capsys.readouterr().out)}
    assert set(told) == set(CHECKS) and told["D-RI-001"]["params"] == [{"name": n, "type": "str", "required": True} for n in ("fk_column", "ref_table", "ref_column")]
    assert told["D-RANGE-001"]["params"][1] == {"name": "min", "type": "float", "required": False} and told["R-DIFF-001"]["needs"] == ["baseline"]
    assert all(n in PARAM_KINDS or n in ("build", "baseline", "queries", "workbooks", "migrated", "resolution") for c in CHECKS.values() for n in c.needs) and len(catalogue()) == len(CHECKS)


def test_baselines_by_command(spark, tmp_path, capsys):
    spark.range(30).selectExpr("id AS k", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    (tmp_path / "b.sql").write_text("SELECT k, v FROM cmd_t")
    (tmp_path / "c.json").write_text('[{"id": "R-DIFF-001"}]')
    base = ["--table", f"cmd_t={tmp_path / 't'}", "--store", str(tmp_path / "s")]
    script = str(tmp_path / "b.sql")
    assert main([*base, "baseline", "list"]) == 0 and "no baselines" in capsys.readouterr().out
    assert main([*base, "baseline", "update", script, "--name", "b"]) == 3
    assert main([*base, "baseline", "create", script, "--name", "b", "--key", "k"]) == 0 and main([*base, "baseline", "create", script, "--name", "b"]) == 3
    assert main([*base, "baseline", "update", script, "--name", "b"]) == 0
    capsys.readouterr()
    assert main([*base, "baseline", "list"]) == 0 and "b  30 rows" in capsys.readouterr().out
    assert main([*base, "check", script, "--checks", str(tmp_path / "c.json"), "--baseline", "b"]) == 0
    (tmp_path / "b.sql").write_text("SELECT k, v + CASE WHEN k = 3 THEN 1 ELSE 0 END AS v FROM cmd_t")
    assert main([*base, "check", script, "--checks", str(tmp_path / "c.json"), "--baseline", "b"]) == 1
    assert "2 different rows" in capsys.readouterr().out


def test_parity_by_command(spark, tmp_path, capsys):
    spark.range(30).selectExpr("id AS k", "id * 2 AS v").write.parquet(str(tmp_path / "old"))
    spark.range(30).selectExpr("id AS K", "id * 2 AS V").write.parquet(str(tmp_path / "new"))
    _workbook(tmp_path / "w.twb", ["objects"])
    (tmp_path / "m.yml").write_text("version: 1\nobjects:\n  - {old: DB.S.objects, new: NEW.S.objects, keys: [k]}\n")
    base = ["--store", str(tmp_path / "s"), "--table", f"DB.S.objects={tmp_path / 'old'}"]
    ask = [str(tmp_path / "w.twb"), "--map", str(tmp_path / "m.yml")]
    assert main([*base, "parity", "snapshot", *ask]) == 0
    assert main([*base, "--table", f"NEW.S.objects={tmp_path / 'new'}", "parity", "check", *ask]) == 0
    capsys.readouterr()
    assert main([*base, "parity", "check", *ask]) == 2 and "there is no table NEW.S.objects" in capsys.readouterr().out
    assert main([*base, "parity", "check", *ask, "--static-only"]) == 0 and main([*base, "parity", "run", *ask, "--static-only"]) == 3
    assert main([*base, "--table", f"b={tmp_path / 'new'}", "compare", "DB.S.objects", "b"]) == 0
    assert main([*base, "compare", "DB.S.objects", "no.such.table"]) == 3


def test_workbooks_at_once_one_cancelled(spark, tmp_path):
    """Twenty workbooks share the executors; one never ends, is cancelled by its tag, and stops no other."""
    good = spark.range(40).selectExpr("id AS k", "id % 3 AS g")
    wait = F.udf(lambda k: time.sleep(60) or k, "long")
    tables = {"DB.S.good": good, "DB.S.slow": spark.range(8).select(wait("id").alias("k"))}
    for k in range(19):
        _workbook(tmp_path / f"w{k:02d}.twb", ["good"])
    _workbook(tmp_path / "w19.twb", ["slow"])
    listed, store = estate_of(str(tmp_path / "*.twb")), BaselineStore(spark, str(tmp_path / "s"))
    threading.Timer(12, lambda: spark.sparkContext.cancelJobsWithTag(job_tag(listed[19]))).start()
    began = time.monotonic()
    estate = run_estate(spark, listed, store, "snapshot", at_once=20, identity=True, tables=tables)
    assert time.monotonic() - began < 60
    assert [estate.verdict_of(w.path) for w in listed] == ["READY"] * 19 + ["BLOCKED"] and list(estate.errors) == [listed[19].path]
    late = run_estate(spark, listed[18:], store, "snapshot", at_once=2, seconds=3, identity=True, tables=tables)
    assert "took more than 3 s" in late.errors[listed[19].path] or late.errors[listed[19].path]
    assert late.verdict_of(listed[19].path) == "BLOCKED"
