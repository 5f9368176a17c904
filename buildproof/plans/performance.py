"""Performance checks on what Spark planned and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalyst import items, kind

#: Scans of fewer partitions aren't worth a remark.
MANY_PARTITIONS = 100


def _nodes(df: DataFrame):
    plan = df._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if kind(node) == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and kind(node).endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        yield node
        stack += items(node.children())


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under a plan of its own, whose metrics start at zero."""
    return df.alias("measured")


def measured(df: DataFrame) -> dict[str, int]:
    """Run a build once, and take rows, bytes read and bytes spilled from its own metrics."""
    df._jdf.queryExecution().toRdd().count()
    most, scanned, size, spilled, partitions, pruned = 0, 0, 0, 0, 0, True
    least = None
    for node in _nodes(df):
        metrics = node.metrics()
        get = lambda name: metrics.get(name).get().value() if metrics.contains(name) else 0
        rows = get("numOutputRows")
        if "Scan" in kind(node):
            scanned += get("numFiles")
            size += get("filesSize")
            partitions += get("numPartitions")
            filters = node.metadata().get("PartitionFilters") if kind(node) == "FileSourceScanExec" else None
            pruned = pruned and not (get("numPartitions") and filters is not None and not filters.isEmpty() and filters.get() == "[]")
            least = rows if rows and (least is None or rows < least) else least
        most = max(most, rows)
        spilled += get("spillSize")
    return {"most_rows": most, "least_scan_rows": least or 0, "files": scanned, "bytes_read": size, "bytes_spilled": spilled, "partitions": partitions, "pruned": int(pruned)}


def judge(facts: dict[str, int], max_bytes: int | None = None, max_files: int | None = None, blow_up: float = 10) -> dict[str, str]:
    """Status per check: pruning (P-PROF-001), cost (P-COST-001), spill (P-SPILL-001), rows that multiply (P-CARD-001)."""
    profile = "SKIP" if not facts["partitions"] else "WARN" if facts["partitions"] >= MANY_PARTITIONS and not facts["pruned"] else "PASS"
    cost = "SKIP" if max_bytes is None and max_files is None else "WARN" if (max_bytes is not None and facts["bytes_read"] > max_bytes) or (max_files is not None and facts["files"] > max_files) else "PASS"
    grown = facts["least_scan_rows"] and facts["most_rows"] >= blow_up * facts["least_scan_rows"]
    return {"P-PROF-001": profile, "P-COST-001": cost, "P-SPILL-001": "WARN" if facts["bytes_spilled"] else "PASS", "P-CARD-001": "WARN" if grown else "PASS"}
