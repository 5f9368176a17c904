"""The registered queries of the package and their SQL twins.

Every query reads the given tables whole. Sums of money are taken as decimals, so that they don't depend on
the order of rows in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checks.verdict import roll_up
from .functions import pii
from .operators import assertions as A
from .operators import evidence as E
from .operators import parity as M
from .operators import regression as R
from .sources.baseline import BaselineStore
from .sources.scratch import new_folder
from .streaming import checks as S

QUERIES = {}
ORACLES = {}

NULLABLE = "SELECT o.*, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal < 0"
MIGRATED = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN round(o_totalprice * 1.1, 2) ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0"
)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 101 <> 0")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.round(F.col("o_totalprice") * 1.1, 2)).otherwise(F.col("o_totalprice"))
    return o.withColumns({"o_totalprice": price, "o_orderpriority": F.when(F.col("o_orderkey") % 89 != 0, F.col("o_orderpriority"))})


# Assertions


@query("d_grain_001", "SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS dup_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def d_grain_001(spark, sf_dir):
    return A.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d_grain_001_summary",
    "SELECT CAST(COUNT(*) AS BIGINT) AS dup_groups, CAST(coalesce(MAX(n), 0) AS BIGINT) AS max_dup FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)",
)
def d_grain_001_summary(spark, sf_dir):
    return A.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d_grain_002", "SELECT CAST(COUNT(*) AS BIGINT) AS row_count FROM orders JOIN customer ON o_custkey = c_custkey")
def d_grain_002(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).agg(A.row_count().alias("row_count"))


@query("d_null_001", f"SELECT CAST(COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS BIGINT) AS nulls_o_orderkey, CAST(COUNT(*) FILTER (WHERE c_name IS NULL) AS BIGINT) AS nulls_c_name FROM ({NULLABLE})")
def d_null_001(spark, sf_dir):
    return A.fused(nullable(spark, sf_dir), {f"nulls_{c}": A.null_count(c) for c in ("o_orderkey", "c_name")})


@query(
    "d_null_002",
    f"WITH t AS ({NULLABLE}), n AS (SELECT CAST(COUNT(*) AS BIGINT) AS total, COUNT(*) FILTER (WHERE c_name IS NULL) AS a, COUNT(*) FILTER (WHERE o_orderdate IS NULL) AS b FROM t) "
    "SELECT 'c_name' AS col_name, total, CAST(a AS BIGINT) AS nulls, a / total AS rate FROM n UNION ALL SELECT 'o_orderdate', total, CAST(b AS BIGINT), b / total FROM n",
)
def d_null_002(spark, sf_dir):
    return A.per_column(nullable(spark, sf_dir), ["c_name", "o_orderdate"], A.null_count, "nulls")


@query(
    "d_blank_001",
    "WITH t AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE lang END AS lang, source FROM documents), "
    "n AS (SELECT CAST(COUNT(*) AS BIGINT) AS total, COUNT(*) FILTER (WHERE trim(lang) = '') AS a, COUNT(*) FILTER (WHERE trim(source) = '') AS b FROM t) "
    "SELECT 'lang' AS col_name, total, CAST(a AS BIGINT) AS blanks, a / total AS rate FROM n UNION ALL SELECT 'source', total, CAST(b AS BIGINT), b / total FROM n",
)
def d_blank_001(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("lang")).alias("lang"), "source")
    return A.per_column(docs, ["lang", "source"], A.blank_count, "blanks")


@query("d_pos_001", "SELECT CAST(COUNT(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS negatives FROM customer")
def d_pos_001(spark, sf_dir):
    return A.fused(table(spark, sf_dir, "customer"), {"negatives": A.negative_count("c_acctbal")})


@query("d_distinct_001", "SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS distinct_count FROM events")
def d_distinct_001(spark, sf_dir):
    return A.distinct_count(table(spark, sf_dir, "events"), "user_id")


@query("d_ri_001", "SELECT CAST(COUNT(*) AS BIGINT) AS orphans FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderstatus = 'F' AND o.o_orderkey = l.l_orderkey)")
def d_ri_001(spark, sf_dir):
    parent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return A.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", parent, "o_orderkey").agg(A.row_count().alias("orphans"))


@query("d_domain_001", "SELECT CAST(COUNT(*) FILTER (WHERE event_type IS NOT NULL AND event_type NOT IN ('click', 'view')) AS BIGINT) AS violations FROM events")
def d_domain_001(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return A.fused(events, {"violations": A.outside_domain(events, "event_type", ["click", "view"])})


@query("d_range_001", "SELECT CAST(COUNT(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS BIGINT) AS violations FROM lineitem")
def d_range_001(spark, sf_dir):
    return A.fused(table(spark, sf_dir, "lineitem"), {"violations": A.outside_range("l_quantity", 5, 45)})


@query("d_fresh_001", "SELECT MAX(ts) AS max_ts, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(MAX(ts))) / 3.6e9 AS age_hours FROM events")
def d_fresh_001(spark, sf_dir):
    return A.freshness(table(spark, sf_dir, "events"), "ts", "2024-02-01 00:00:00")


@query(
    "d_recon_001",
    "WITH m AS (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey), "
    "t AS (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders) "
    "SELECT m.v AS metric, t.v AS truth, abs(m.v - t.v) AS gap, abs(m.v - t.v) <= 0 AS agrees FROM m, t",
)
def d_recon_001(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    build = o.join(c, o.o_custkey == c.c_custkey)
    return A.reconcile(build.agg(R.exact_sum(build, "o_totalprice")), o.agg(R.exact_sum(o, "o_totalprice")))


@query("d_dup_001", "SELECT o_custkey, o_orderstatus, CAST(COUNT(*) AS BIGINT) AS dup_count FROM orders GROUP BY ALL HAVING COUNT(*) > 1")
def d_dup_001(spark, sf_dir):
    return A.duplicate_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))


@query("d_custom_001", "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def d_custom_001(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, (li.l_orderkey == o.o_orderkey) & (li.l_shipdate < o.o_orderdate)).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query(
    "d_fused_suite",
    "SELECT CAST(COUNT(*) AS BIGINT) AS row_count, CAST(COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS BIGINT) AS null_orderkey, CAST(COUNT(*) FILTER (WHERE trim(l_returnflag) = '') AS BIGINT) AS blank_flag, "
    "CAST(COUNT(*) FILTER (WHERE l_discount < 0) AS BIGINT) AS negative_discount, CAST(COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS BIGINT) AS outside_flags, "
    "CAST(COUNT(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 49) AS BIGINT) AS outside_quantity, MAX(l_shipdate) AS latest_ship FROM lineitem",
)
def d_fused_suite(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    metrics = {
        "row_count": A.row_count(),
        "null_orderkey": A.null_count("l_orderkey"),
        "blank_flag": A.blank_count("l_returnflag"),
        "negative_discount": A.negative_count("l_discount"),
        "outside_flags": A.outside_domain(li, "l_returnflag", ["A", "N"]),
        "outside_quantity": A.outside_range("l_quantity", 1, 49),
        "latest_ship": F.max("l_shipdate"),
    }
    return A.fused(li, metrics)


@query("select_capped", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 1000")
def select_capped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy("o_orderkey").limit(1000)


@query("trend_last_20", "SELECT event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def trend_last_20(spark, sf_dir):
    """The last twenty records of every target, newest first."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value").withColumn("rank", F.row_number().over(newest)).filter("rank <= 20").drop("rank")


@query(
    "evidence_per_key",
    "SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 "
    "QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey), l_quantity) <= 20",
)
def evidence_per_key(spark, sf_dir):
    """The violations shown of each return flag: the same twenty under any partitioning."""
    bad = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    mark = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return E.bottom_k(bad, 20, [mark], F.col("l_quantity"), ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


# Regression

_SUM = "CAST(coalesce(SUM(CAST({0} AS DECIMAL(38,{1}))), 0) AS DOUBLE)"


def _fingerprint_sql(source: str) -> str:
    parts = ["SELECT '__row_count' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM " + source]
    for c, scale in (("o_orderkey", 0), ("o_custkey", 0), ("o_totalprice", 2)):
        parts += [f"SELECT 'sum:{c}', {_SUM.format(c, scale)} FROM {source}", f"SELECT 'count:{c}', CAST(COUNT({c}) AS DOUBLE) FROM {source}"]
    return " UNION ALL ".join(parts)


@query("r_agg_fingerprint", _fingerprint_sql("orders"))
def r_agg_fingerprint(spark, sf_dir):
    return R.fingerprint(table(spark, sf_dir, "orders"))


@query(
    "r_agg_001",
    f"WITH c AS ({MIGRATED}), b AS ({_fingerprint_sql('orders')}), n AS ({_fingerprint_sql('c')}) "
    "SELECT b.name, b.value AS baseline, n.value AS current FROM b LEFT JOIN n USING (name) WHERE n.value IS NULL OR abs(n.value - b.value) > abs(b.value) * 0.001",
)
def r_agg_001(spark, sf_dir):
    return R.fingerprint_breaches(R.fingerprint(migrated(spark, sf_dir)), R.fingerprint(table(spark, sf_dir, "orders")), 0.001)


@query("r_diff_added", f"({MIGRATED}) EXCEPT ALL SELECT * FROM orders")
def r_diff_added(spark, sf_dir):
    return R.added_rows(migrated(spark, sf_dir), table(spark, sf_dir, "orders"))


@query("r_diff_removed", f"SELECT * FROM orders EXCEPT ALL ({MIGRATED})")
def r_diff_removed(spark, sf_dir):
    return R.removed_rows(migrated(spark, sf_dir), table(spark, sf_dir, "orders"))


@query(
    "r_diff_001",
    f"WITH c AS ({MIGRATED}), a AS (SELECT * FROM c EXCEPT ALL SELECT * FROM orders), r AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM c) "
    "SELECT 'added' AS change, CAST(COUNT(*) AS BIGINT) AS n FROM a UNION ALL SELECT 'removed', CAST(COUNT(*) AS BIGINT) FROM r",
)
def r_diff_001(spark, sf_dir):
    changes = R.row_changes(migrated(spark, sf_dir), table(spark, sf_dir, "orders"))
    return changes.groupBy(F.col("__change").alias("change")).agg(F.sum("__times").alias("n"))


@query("r_diff_tree", ORACLES["r_diff_001"])
def r_diff_tree(spark, sf_dir):
    """r_diff_001 by the tree kept beside a baseline: only leaves that differ are read of it."""
    store = BaselineStore(spark, new_folder(spark, "baselines"))
    store.save("orders", table(spark, sf_dir, "orders"), tree=True, keys=["o_orderkey"])
    return store.row_changes("orders", migrated(spark, sf_dir)).groupBy(F.col("__change").alias("change")).agg(F.sum("__times").alias("n"))


# Migration parity

_COLUMNS = (("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", None), ("o_totalprice", 2), ("o_orderdate", None), ("o_orderpriority", None))


def _measure_sql(source: str) -> str:
    parts = [f"SELECT 'row_count' AS kind, '' AS col_name, CAST(COUNT(*) AS DOUBLE) AS value FROM {source}"]
    for c, scale in _COLUMNS:
        parts.append(f"SELECT 'null_count', '{c}', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM {source}")
        if scale is not None:
            parts += [f"SELECT 'sum', '{c}', {_SUM.format(c, scale)} FROM {source}", *[f"SELECT '{f}', '{c}', CAST({f}({c}) AS DOUBLE) FROM {source}" for f in ("min", "max")]]
    for key in ("o_orderkey", "o_custkey"):
        parts.append(f"SELECT 'distinct', '{key}', CAST(COUNT(DISTINCT {key}) AS DOUBLE) FROM {source}")
    return " UNION ALL ".join(parts)


_PAIR = f"WITH c AS ({MIGRATED}), o AS ({_measure_sql('orders')}), n AS ({_measure_sql('c')}) "
_DIFF = "CASE WHEN n.value = o.value THEN 0.0 ELSE abs(n.value - o.value) / greatest(abs(o.value), 1e-9) END"


def _compared_sql(kinds: str, tolerance: float) -> str:
    return _PAIR + f"SELECT kind, col_name, o.value AS old_value, n.value AS new_value, {_DIFF} AS diff, {_DIFF} > {tolerance} AS breach FROM o JOIN n USING (kind, col_name) WHERE kind IN ({kinds})"


def _measured(spark, sf_dir):
    return M.measure(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]), M.measure(migrated(spark, sf_dir), ["o_orderkey", "o_custkey"])


@query("m_metrics", _measure_sql("orders"))
def m_metrics(spark, sf_dir):
    return M.measure(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]).filter("kind not in ('nan', 'inf', '-inf')").drop("exact")


_IRREGULAR = "SELECT event_id, CASE WHEN event_id % 997 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 991 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS value FROM events"
_NAN_SQL = "SELECT 'nan' AS kind, CAST(COUNT(*) FILTER (WHERE isnan(value)) AS DOUBLE) AS v FROM {0} UNION ALL SELECT 'inf', CAST(COUNT(*) FILTER (WHERE value = CAST('inf' AS DOUBLE)) AS DOUBLE) FROM {0}"


@query(
    "r_agg_nan",
    f"WITH c AS ({_IRREGULAR}), b AS ({_NAN_SQL.format('events')}), n AS ({_NAN_SQL.format('c')}) "
    "SELECT kind || ':value' AS name, b.v AS baseline, n.v AS current FROM b JOIN n USING (kind) WHERE b.v <> n.v",
)
def r_agg_nan(spark, sf_dir):
    """Figures that moved where some values became NaN or infinite; the sum, which leaves those out, moves as well and is left to r_agg_001."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    value = F.when(F.col("event_id") % 997 == 0, float("nan")).when(F.col("event_id") % 991 == 0, float("inf")).otherwise(F.col("value"))
    moved = R.fingerprint_breaches(R.fingerprint(events.withColumn("value", value), irregular=True), R.fingerprint(events, irregular=True))
    return moved.filter("name not like 'sum:%'")


_LARGE = 1 << 53


@query(
    "m_agg_exact",
    f"WITH o AS (SELECT o_orderkey + {_LARGE} AS k FROM orders), n AS (SELECT k + 1 AS k FROM o) "
    "SELECT kind, 'k' AS col_name, a > b AS breach FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS kind, (SELECT {f}(k) FROM n) AS a, (SELECT {f}(k) FROM o) AS b" for f in ("sum", "min", "max"))
    + ")",
)
def m_agg_exact(spark, sf_dir):
    """Integers beyond the digits of a double, each one larger on the new side: sums and extremes differ by all digits."""
    old = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + _LARGE).alias("k"))
    return M.compare_metrics(M.measure(old), M.measure(old.select((F.col("k") + 1).alias("k"))), ["sum", "min", "max"], 0.0).select("kind", "col_name", "breach")


@query(
    "m_hash_case",
    f"WITH c AS ({MIGRATED}) SELECT CAST(coalesce(o.o_orderkey, c.o_orderkey) AS VARCHAR) AS o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'missing' ELSE 'mismatch' END AS state "
    "FROM orders o LEFT JOIN c ON o.o_orderkey = c.o_orderkey WHERE c.o_orderkey IS NULL OR o.o_totalprice IS DISTINCT FROM c.o_totalprice OR o.o_orderpriority IS DISTINCT FROM c.o_orderpriority",
)
def m_hash_case(spark, sf_dir):
    """Rows by key where the migrated side spells all its columns in upper case."""
    new = migrated(spark, sf_dir)
    return M.compare_rows(table(spark, sf_dir, "orders"), new.toDF(*[c.upper() for c in new.columns]), ["O_ORDERKEY"])


@query("m_row_001", _compared_sql("'row_count'", 0.0))
def m_row_001(spark, sf_dir):
    return M.compare_metrics(*_measured(spark, sf_dir), ["row_count"], 0.0)


@query("m_agg_001", _compared_sql("'sum', 'min', 'max'", 0.01))
def m_agg_001(spark, sf_dir):
    return M.compare_metrics(*_measured(spark, sf_dir), ["sum", "min", "max"], 0.01)


@query("m_dist_001", _compared_sql("'distinct'", 0.001))
def m_dist_001(spark, sf_dir):
    return M.compare_metrics(*_measured(spark, sf_dir), ["distinct"], 0.001)


@query(
    "m_null_001",
    _PAIR + "SELECT kind, col_name, o.value AS old_value, n.value AS new_value, abs(n.value - o.value) / t.rows AS diff, abs(n.value - o.value) / t.rows > 0.01 AS breach "
    "FROM o JOIN n USING (kind, col_name), (SELECT greatest(COUNT(*), 1) AS rows FROM orders) t WHERE kind = 'null_count'",
)
def m_null_001(spark, sf_dir):
    return M.compare_nulls(*_measured(spark, sf_dir), 0.01)


_RETYPED = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderdate, TRUE AS o_orderpriority, 1 AS further FROM orders"
_KIND = "CASE WHEN regexp_matches({0}, 'INT|DOUBLE|FLOAT|DECIMAL') THEN 'numeric' WHEN {0} = 'VARCHAR' THEN 'text' WHEN regexp_matches({0}, '^(DATE|TIMESTAMP)') THEN 'date-time' WHEN {0} = 'BOOLEAN' THEN 'boolean' ELSE 'other' END"


@query(
    "m_schema_001",
    f"WITH a AS (SELECT column_name AS col_name, {_KIND.format('column_type')} AS kind FROM (DESCRIBE SELECT * FROM orders)), b AS (SELECT column_name AS col_name, {_KIND.format('column_type')} AS kind FROM (DESCRIBE {_RETYPED})), "
    + "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col_name, COUNT({c}) AS n FROM orders" for c, _ in _COLUMNS) + ") "
    "SELECT a.col_name, CASE WHEN b.kind IS NULL THEN 'missing' ELSE a.kind || ' became ' || b.kind END AS state, CAST(v.n AS BIGINT) AS n_values "
    "FROM a JOIN v USING (col_name) LEFT JOIN b USING (col_name) WHERE b.kind IS NULL OR b.kind <> a.kind",
)
def m_schema_001(spark, sf_dir):
    """Columns that a migration lost or changed in kind, and how many values of the legacy table that concerns."""
    orders = table(spark, sf_dir, "orders")
    new = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderdate", F.lit(True).alias("o_orderpriority"), F.lit(1).alias("further"))
    return M.schema_losses(orders, new)


@query("m_grain_groups", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS group_count FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def m_grain_groups(spark, sf_dir):
    return M.grain_groups(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], 20)


@query(
    "m_grain_001",
    f"WITH c AS ({MIGRATED}), a AS (SELECT coalesce(o_orderpriority, '∅') AS o_orderpriority, o_orderstatus, COUNT(*) AS old_count FROM orders GROUP BY 1, 2), "
    "b AS (SELECT coalesce(o_orderpriority, '∅') AS o_orderpriority, o_orderstatus, COUNT(*) AS new_count FROM c GROUP BY 1, 2) "
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, CAST(old_count AS BIGINT) AS old_count, CAST(new_count AS BIGINT) AS new_count, "
    "CASE WHEN new_count IS NULL THEN 'missing' WHEN old_count IS NULL THEN 'extra' WHEN abs(new_count - old_count) / greatest(old_count, 1e-9) > 0.02 THEN 'mismatch' END AS state "
    "FROM a FULL JOIN b USING (o_orderpriority, o_orderstatus)) WHERE state IS NOT NULL",
)
def m_grain_001(spark, sf_dir):
    grain = ["o_orderpriority", "o_orderstatus"]
    return M.compare_grain(M.grain_groups(table(spark, sf_dir, "orders"), grain), M.grain_groups(migrated(spark, sf_dir), grain), grain, 0.02)


@query(
    "m_hash_001",
    f"WITH c AS ({MIGRATED}) SELECT CAST(coalesce(o.o_orderkey, c.o_orderkey) AS VARCHAR) AS o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' ELSE 'mismatch' END AS state "
    "FROM orders o FULL JOIN c ON o.o_orderkey = c.o_orderkey WHERE c.o_orderkey IS NULL OR o.o_orderkey IS NULL OR o.o_custkey IS DISTINCT FROM c.o_custkey OR o.o_orderstatus IS DISTINCT FROM c.o_orderstatus "
    "OR o.o_totalprice IS DISTINCT FROM c.o_totalprice OR o.o_orderdate IS DISTINCT FROM c.o_orderdate OR o.o_orderpriority IS DISTINCT FROM c.o_orderpriority",
)
def m_hash_001(spark, sf_dir):
    return M.compare_rows(table(spark, sf_dir, "orders"), migrated(spark, sf_dir), ["o_orderkey"])


@query(
    "m_rename_agg",
    f"WITH c AS (SELECT o_orderkey, o_totalprice AS price_amt FROM ({MIGRATED})) "
    "SELECT 'sum' AS kind, 'o_totalprice' AS col_name, o.v AS old_value, n.v AS new_value, abs(n.v - o.v) / greatest(abs(o.v), 1e-9) AS diff, abs(n.v - o.v) / greatest(abs(o.v), 1e-9) > 0.01 AS breach "
    f"FROM (SELECT {_SUM.format('o_totalprice', 2)} AS v FROM orders) o, (SELECT {_SUM.format('price_amt', 2)} AS v FROM c) n",
)
def m_rename_agg(spark, sf_dir):
    new = M.renamed(migrated(spark, sf_dir).select(F.col("o_totalprice").alias("price_amt")), {"price_amt": "o_totalprice"})
    return M.compare_metrics(M.measure(table(spark, sf_dir, "orders").select("o_totalprice")), M.measure(new), ["sum"], 0.01)


@query("m_row_hash_classes", "SELECT n, CAST(COUNT(*) AS BIGINT) AS classes FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_quantity, l_returnflag, l_shipdate) GROUP BY n")
def m_row_hash_classes(spark, sf_dir):
    """Sizes of the classes of rows with one hash: those of equal rows, if and only if hashes are equal exactly where rows are."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_shipdate")
    classes = lines.groupBy(M.row_hash(lines, lines.columns).alias("h")).agg(A.row_count().alias("n"))
    return classes.groupBy("n").agg(A.row_count().alias("classes"))


@query("m_row_hash")
def m_row_hash(spark, sf_dir):
    """The hash of every row, by key; the values are this engine's own."""
    return M.hashed_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])


# Personal data and verdicts


@query(
    "pii_scan_documents",
    "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{pii.PATTERNS[k]}')) AS BIGINT) AS n_{k}" for k in pii.PATTERNS) + " FROM documents",
)
def pii_scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[pii.count_matches(F.col("text"), k).alias(f"n_{k}") for k in pii.PATTERNS])


def _hidden_sql() -> str:
    out = "text"
    for pattern in pii.PATTERNS.values():
        out = f"regexp_replace({out}, '{pattern}', '{pii.HIDDEN}', 'g')"
    return out


_DIGIT = "CAST(substr(s, length(s) - i, 1) AS INTEGER)"
_CHECK = f"list_sum(list_transform(range(0, length(s)), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END))"
_CARDS = f"list_filter(list_transform(regexp_extract_all(text, '{pii.CARD}'), lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda s: {_CHECK} % 10 = 0)"


@query("pii_redact_documents", f"SELECT doc_id, sha256(CASE WHEN len({_CARDS}) > 0 THEN '{pii.HIDDEN}' ELSE {_hidden_sql()} END) AS text_sha256 FROM documents")
def pii_redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pii.hide_all(F.col("text")), 256).alias("text_sha256"))


@query(
    "pii_cards_documents",
    f"WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pii.CARD}')) AS x FROM documents), d AS (SELECT doc_id, regexp_replace(x, '[ -]', '', 'g') AS s FROM f) "
    f"SELECT doc_id, CAST(COUNT(*) AS INTEGER) AS n_cards FROM d WHERE {_CHECK} % 10 = 0 GROUP BY doc_id",
)
def pii_cards_documents(spark, sf_dir):
    """Documents with numbers that pass the check digit of payment cards."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pii.card_numbers(F.col("text"))).alias("n_cards")).filter("n_cards > 0")


@query(
    "verdict_rollup",
    """
    WITH s AS (SELECT c_nationkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE c_acctbal < 0) AS bad, COUNT(*) FILTER (WHERE c_name IS NULL) AS nulls, COUNT(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1),
    r AS (SELECT c_nationkey, 'BLOCKER' AS severity, CASE WHEN nulls > 0 OR n < 40 THEN 'FAIL' ELSE 'PASS' END AS status FROM s
          UNION ALL SELECT c_nationkey, 'HIGH', CASE WHEN bad * 10 > n THEN 'FAIL' ELSE 'PASS' END FROM s
          UNION ALL SELECT c_nationkey, 'LOW', CASE WHEN segments < 5 THEN 'WARN' WHEN bad > 0 THEN 'WARN' ELSE 'PASS' END FROM s)
    SELECT c_nationkey, CASE WHEN bool_or(severity = 'BLOCKER' AND status = 'FAIL') THEN 'BLOCKED' WHEN bool_or(severity = 'HIGH' AND status = 'FAIL') THEN 'REVIEW'
           WHEN bool_or(status IN ('FAIL', 'ERROR', 'WARN')) THEN 'READY_WITH_NOTES' ELSE 'READY' END AS verdict,
           CAST(COUNT(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS failures FROM r GROUP BY 1
    """,
)
def verdict_rollup(spark, sf_dir):
    """Three checks on every nation's customers, folded into a verdict per nation."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(A.row_count().alias("n"), A.negative_count("c_acctbal").alias("bad"), A.null_count("c_name").alias("nulls"), F.count_distinct("c_mktsegment").alias("segments"))
    check = lambda severity, fail, otherwise: F.struct(F.lit(severity).alias("severity"), F.when(fail, otherwise).otherwise("PASS").alias("status"))
    found = F.array(
        check("BLOCKER", (F.col("nulls") > 0) | (F.col("n") < 40), "FAIL"),
        check("HIGH", F.col("bad") * 10 > F.col("n"), "FAIL"),
        check("LOW", (F.col("segments") < 5) | (F.col("bad") > 0), "WARN"),
    )
    results = per.select("c_nationkey", F.explode(found).alias("r")).select("c_nationkey", "r.*")
    return roll_up(results, "c_nationkey")


# Streams


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream, a file at a time."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")


@query(
    "stream_duplicate_keys",
    "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL), m AS (SELECT MAX(ts) AS ts FROM events) "
    "SELECT w.window_start, user_id, event_type, CAST(n AS BIGINT) AS dup_count FROM w, m WHERE n > 1 AND w.window_start + INTERVAL 1 HOUR <= m.ts - INTERVAL 2 HOURS",
)
def stream_duplicate_keys(spark, sf_dir):
    """Users with several events of a kind within an hour, from the stream of events; windows are final two hours later."""
    found = S.replayed(_event_stream(spark, sf_dir), "duplicates", lambda s: S.duplicate_keys(s, ["user_id", "event_type"], "ts", "1 hour", "2 hours"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_orphans",
    "WITH m AS (SELECT least(MAX(ts) FILTER (WHERE event_type = 'click'), MAX(ts) FILTER (WHERE event_type = 'view')) AS ts FROM events), p AS (SELECT user_id, ts FROM events WHERE event_type = 'view') "
    "SELECT c.event_id, c.user_id FROM events c, m WHERE event_type = 'click' AND c.ts + INTERVAL 1 HOUR < m.ts - INTERVAL 1 DAY "
    "AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.ts >= c.ts - INTERVAL 1 DAY AND p.ts <= c.ts + INTERVAL 1 HOUR)",
)
def stream_orphans(spark, sf_dir):
    """Clicks without a view of the same user in the day before or the hour after, from two streams of events."""
    s = _event_stream(spark, sf_dir)
    child, parent = s.filter("event_type = 'click'").select("event_id", "user_id", "ts"), s.filter("event_type = 'view'").select("user_id", "ts")
    return S.replayed(s, "orphans", lambda _: S.orphans(child, "user_id", "ts", parent, "user_id", "ts", "1 DAY", "1 HOUR", "1 day").select("event_id", "user_id"))
