"""python -m buildproof.cli: check a build, keep baselines, compare tables and the objects of workbooks."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import SparkSession

from .checks import audit, ruleset
from .checks.estate import MODES, Listed, estate_of, read_object, run_estate, run_parity
from .checks.limits import limited
from .checks.registry import CHECKS, Context, catalogue
from .checks.report import as_html, as_json, as_junit, estate_as_html, estate_as_json, estate_as_junit
from .checks.runner import Run, Spec, run_checks
from .checks.verdict import EXIT_CODES, TOOL_ERROR, coverage, summary, verdict
from .operators.parity import compare_metrics, measure
from .plans.build import fold
from .plans.lineage import lineage
from .sources import mapping
from .sources.baseline import BaselineStore, canonical_name
from .sources.workbook import read_workbooks

#: The file of the pinned version unless another is named.
PIN = "ruleset.pin"
SAMPLES = {
    "ruleset.yml": """version: "1"
defaults: {fail_on: REVIEW, evidence_sample_rows: 20}
checks:
  - id: D-GRAIN-001
    params: {key: [id]}
  - id: D-NULL-002
    params: {columns: [amount], threshold: 0.01}
  - id: S-STAT-001
""",
    "map.yml": """version: 1
defaults: {tolerance_pct: 0.01}
objects:
  - {old: OLD_DB.SALES.ORDERS, new: NEW_DB.SALES.ORDERS, keys: [order_id], grain: [region]}
""",
}


def doctor() -> list[tuple[str, bool, str]]:
    """(what, whether it works, what was seen) of the parts that a run needs."""

    def session() -> str:
        spark = SparkSession.builder.appName("buildproof").getOrCreate()
        return f"Spark {spark.version} counts {spark.range(10).count()}"

    def answer() -> str:
        spark = SparkSession.builder.getOrCreate()
        return run_checks(Context(spark.range(3).toDF("k")), [Spec("D-GRAIN-001", {"key": ["k"]})]).verdict

    def yaml_there() -> str:
        import yaml

        return yaml.__version__

    out = []
    for what, see in (("python", lambda: sys.version.split()[0]), ("session", session), ("checks", lambda: str(len(CHECKS))), ("a run", answer), ("rulesets", yaml_there)):
        try:
            out.append((what, True, see()))
        except Exception as error:
            out.append((what, False, str(error).splitlines()[0] if str(error) else type(error).__name__))
    return out


def _arguments(argv):
    parser = argparse.ArgumentParser(prog="buildproof", description=__doc__)
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table to register; a name with dots is the full name of an object of a workbook or map")
    parser.add_argument("--store", default="baselines", help="folder of baselines")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="run checks on a build script")
    check.add_argument("script")
    check.add_argument("--checks", help="JSON list of {id, params, enabled, severity}")
    check.add_argument("--ruleset", help="YAML ruleset; --checks come on top")
    check.add_argument("--profile", help="YAML profile laid over the ruleset")
    check.add_argument("--pin", help="file with the only version of the ruleset that is accepted")
    check.add_argument("--audit", help="log to which a line is added")
    check.add_argument("--format", choices=("json", "junit", "html"), default="json")
    check.add_argument("--baseline")
    check.add_argument("--as-of")
    check.add_argument("--workbooks", help="folder or glob of BI workbooks")
    check.add_argument("--map", help="JSON object map of a migration")
    check.add_argument("--snapshot", help="name of the legacy object's snapshot in the store; needs --map")
    kept = commands.add_parser("baseline", help="keep results of build scripts").add_subparsers(dest="action", required=True)
    for action, what in (("save", "keep a result, the first one or a newer"), ("create", "keep a first result"), ("update", "keep a newer result")):
        save = kept.add_parser(action, help=what)
        save.add_argument("script")
        save.add_argument("--name")
        save.add_argument("--key", action="append", default=[], help="a column that the rows are laid out by, so that a changed row touches one leaf")
    kept.add_parser("list", help="show what is kept")
    rules = commands.add_parser("rules", help="pin or fetch rulesets").add_subparsers(dest="action", required=True)
    pin = rules.add_parser("pin", help="let runs accept one version only")
    pin.add_argument("version")
    show = rules.add_parser("show", help="say which version is pinned")
    for one in (pin, show):
        one.add_argument("--pin", default=PIN, help="file of the pin")
    pulled = rules.add_parser("pull", help="copy the rulesets of a checkout")
    pulled.add_argument("source")
    pulled.add_argument("folder")
    start = commands.add_parser("init", help="write a sample ruleset and object map; what is there stays")
    start.add_argument("folder", nargs="?", default=".")
    two = commands.add_parser("compare", help="compare the figures of two tables")
    two.add_argument("old")
    two.add_argument("new")
    two.add_argument("--tolerance", type=float, default=0.01)
    parity = commands.add_parser("parity", help="measure or compare the objects of one workbook")
    parity.add_argument("mode", choices=MODES)
    parity.add_argument("workbook")
    parity.add_argument("--map", help="YAML object map; without it all names stay")
    parity.add_argument("--prefix", help="what the snapshots are named by, if not by the workbook")
    parity.add_argument("--swapped", action="store_true", help="the workbook names the migrated objects already")
    parity.add_argument("--identity", action="store_true", help="objects that the map lacks kept their names")
    parity.add_argument("--static-only", action="store_true", help="sources and map only, no table is read")
    parity.add_argument("--ruleset", help="YAML ruleset: severities, checks left out, and the verdict that fails")
    parity.add_argument("--format", choices=("json", "junit", "html"), default="json")
    estate = commands.add_parser("estate", help="measure or compare the objects of workbooks")
    estate.add_argument("mode", choices=MODES)
    estate.add_argument("workbooks", help="YAML manifest or glob")
    estate.add_argument("--map", help="YAML object map for workbooks without their own")
    estate.add_argument("--swapped", action="store_true", help="the workbooks name the migrated objects already")
    estate.add_argument("--identity", action="store_true", help="objects that the map lacks kept their names")
    estate.add_argument("--at-once", type=int, default=1, help="workbooks that run at the same time")
    estate.add_argument("--seconds", type=float, help="time limit of a workbook in a phase")
    estate.add_argument("--format", choices=("json", "junit", "html"), default="json")
    graph = commands.add_parser("lineage", help="show what a query reads and how it is joined")
    graph.add_argument("script")
    runs = commands.add_parser("history", help="show the last runs of every target")
    runs.add_argument("log")
    runs.add_argument("--last", type=int, default=20)
    commands.add_parser("doctor", help="say whether this installation works")
    listed = commands.add_parser("list", help="list the checks")
    listed.add_argument("--format", choices=("text", "json"), default="text", help="json has the parameters as well")
    given, at = list(sys.argv[1:] if argv is None else argv), 0
    while at < len(given) and given[at].startswith("--"):  # options before the command
        at += 1 if "=" in given[at] else 2
    after = given[at + 1] if at + 1 < len(given) else "--help"
    if given[at : at + 1] == ["baseline"] and after not in ("save", "create", "update", "list", "-h", "--help"):
        given.insert(at + 1, "save")  # a script alone
    if given[at : at + 1] == ["parity"] and after not in (*MODES, "-h", "--help"):
        given[at] = "compare"  # two tables
    return parser.parse_args(given)


def main(argv=None) -> int:
    args = _arguments(argv)
    try:
        if args.command == "list":
            print(json.dumps(catalogue(), indent=2) if args.format == "json" else "\n".join(f"{c.id}  {c.severity}  {c.name}" for c in CHECKS.values()))
            return 0
        if args.command == "rules":
            if args.action == "pull":
                print("\n".join(ruleset.pull(args.source, args.folder)))
            elif args.action == "pin":
                ruleset.write_pin(args.pin, args.version)
            else:
                print(ruleset.read_pin(args.pin) or "no version is pinned")
            return 0
        if args.command == "init":
            for name, content in SAMPLES.items():
                at = Path(args.folder) / name
                at.parent.mkdir(parents=True, exist_ok=True)
                if not at.exists():
                    at.write_text(content, encoding="utf-8")
                    print(at)
            return 0
        if args.command == "doctor":
            found = doctor()
            print("\n".join(f"{'ok' if ok else 'FAIL'}  {what}: {said}" for what, ok, said in found))
            return 0 if all(ok for _, ok, _ in found) else TOOL_ERROR
        spark = SparkSession.builder.appName("buildproof").getOrCreate()
        tables = {}
        for one in args.table:
            name, _, path = one.partition("=")
            tables[name] = spark.read.parquet(path)
            if "." not in name:
                tables[name].createOrReplaceTempView(name)
        if args.command == "parity":
            rules = ruleset.load(args.ruleset) if args.ruleset else ruleset.Ruleset("none")
            results = run_parity(spark, Listed(args.workbook, args.map, args.prefix), BaselineStore(spark, args.store), args.mode, swapped=args.swapped, identity=args.identity, tables=tables, static_only=args.static_only)
            off = {c.id for c in rules.checks if not c.enabled}
            results = [replace(r, severity=rules.severity_overrides.get(r.id, r.severity)) for r in results if r.id not in off]
            run = Run(results, verdict(results), summary(results), coverage(results, ("migration_parity",)))
            print({"json": as_json, "junit": as_junit, "html": as_html}[args.format](run))
            return EXIT_CODES[run.verdict] or (1 if args.ruleset and rules.fails(run.verdict) else 0)
        if args.command == "compare":
            found = compare_metrics(measure(read_object(spark, args.old, tables)), measure(read_object(spark, args.new, tables)), ["row_count", "sum", "min", "max"], args.tolerance).collect()
            print(json.dumps([r.asDict() for r in found], indent=2))
            return 2 if any(r.breach for r in found) else 0
        if args.command == "estate":
            estate = run_estate(spark, estate_of(args.workbooks, args.map), BaselineStore(spark, args.store), args.mode, swapped=args.swapped, identity=args.identity, tables=tables, at_once=args.at_once, seconds=args.seconds)
            print({"json": estate_as_json, "junit": estate_as_junit, "html": estate_as_html}[args.format](estate))
            return EXIT_CODES[estate.verdict]
        if args.command == "lineage":
            graph = lineage(spark, Path(args.script).read_text(encoding="utf-8-sig"))
            print(json.dumps({"nodes": [asdict(n) for n in graph.nodes.values()], "edges": [asdict(e) for e in graph.edges], "risks": graph.risks}, indent=2))
            return 1 if graph.risks else 0
        if args.command == "history":
            print("\n".join(r for r in audit.trend(audit.history(spark, args.log), args.last).orderBy("target", "n").toJSON().collect()))
            return 0
        if args.command == "baseline" and args.action == "list":
            print("\n".join(f"{r.name}  {r.row_count} rows  {r.created_at}" for r in BaselineStore(spark, args.store).index().orderBy("name").toLocalIterator()) or "no baselines are kept")
            return 0
        build = fold(spark, Path(args.script).read_text(encoding="utf-8-sig"))
        store = BaselineStore(spark, args.store)
        name = getattr(args, "name", None) or getattr(args, "baseline", None) or canonical_name(build.name or Path(args.script).stem)
        if args.command == "baseline":
            if args.action != "save" and store.exists(name) != (args.action == "update"):
                raise ValueError(f"there is {'no' if args.action == 'update' else 'already a'} baseline {name}")
            print(json.dumps(store.save(name, build.result, tree=True, keys=args.key), indent=2))
            return 0
        specs = [Spec(**s) for s in json.loads(Path(args.checks).read_text())] if args.checks else []
        rules = ruleset.load(args.ruleset, ruleset.read_pin(args.pin) if args.pin else None) if args.ruleset else ruleset.Ruleset("none")
        if args.profile:
            rules = ruleset.overlaid(rules, ruleset.read_mapping(args.profile), args.profile)
        if not args.checks and not args.ruleset:
            raise ValueError("--checks or --ruleset is needed")
        specs = [*rules.specs(), *specs]
        migrated = None
        if args.snapshot:
            old = store.manifest(f"{args.snapshot}__metrics")["object"]
            entries, _ = mapping.load(json.loads(Path(args.map).read_text()))
            migrated = (store, args.snapshot, build.result, next(e for e in entries if mapping.same_object(e.old, old)))
        workbooks = read_workbooks(spark, args.workbooks) if args.workbooks else None
        baseline = store.load(name) if store.exists(name) else None
        shown = rules.defaults
        context = Context(build.result, baseline=baseline, kept=(store, name) if baseline is not None else None, as_of=args.as_of, queries=tuple(build.queries), workbooks=workbooks, migrated=migrated, evidence_rows=shown.evidence_sample_rows, aggregate_only=shown.aggregate_only, pii_names=rules.pii_column_patterns, redact=shown.redact_pii)
        with limited(spark, f"check-{name}", shown.statement_timeout_s * max(len(specs), 1) if args.ruleset else None):
            run = run_checks(context, specs)
        if args.audit:
            audit.append(args.audit, audit.record(run, name, args.script, rules.version, args.profile or ""))
        print({"json": as_json, "junit": as_junit, "html": as_html}[args.format](run))
        return EXIT_CODES[run.verdict] or (1 if args.ruleset and rules.fails(run.verdict) else 0)
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return TOOL_ERROR


if __name__ == "__main__":
    sys.exit(main())
