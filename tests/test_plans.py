import pytest

from buildproof.plans.catalyst import NotReadOnly, assert_read_only, column_sources, scan_facts, table_names
from buildproof.plans.static import check, mismatched_keys

READS = [
    "SELECT 1",
    "SELECT a FROM t WHERE b IN (SELECT c FROM u)",
    "WITH x AS (SELECT a FROM t) SELECT * FROM x",
    "SELECT a FROM t UNION ALL SELECT b FROM u",
    "(SELECT a FROM t) EXCEPT SELECT b FROM u",
    "EXPLAIN SELECT a FROM t",
    "SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) FROM t",
    "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3",
    "SELECT x FROM t LATERAL VIEW explode(y) AS x",
    "VALUES (1), (2)",
    "SELECT 'DROP TABLE t' AS note",
]
WRITES = [
    "",
    ";",
    "DROP TABLE t",
    "DELETE FROM t",
    "UPDATE t SET a = 1",
    "INSERT INTO t SELECT 1",
    "INSERT OVERWRITE t SELECT 1",
    "CREATE TABLE t AS SELECT 1",
    "CREATE VIEW v AS SELECT 1",
    "CREATE OR REPLACE TEMP VIEW v AS SELECT 1",
    "ALTER TABLE t ADD COLUMN x INT",
    "TRUNCATE TABLE t",
    "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE",
    "SET x = 1",
    "USE db",
    "CACHE TABLE t",
    "ANALYZE TABLE t COMPUTE STATISTICS",
    "SELECT 1; SELECT 2",
    "SELECT 1; DROP TABLE t",
    "SHOW TABLES",
    "DESCRIBE t",
    "REFRESH TABLE t",
    "EXPLAIN DROP TABLE t",
    "CALL p()",
    "BEGIN SELECT 1; END",
    "not sql at all",
]


@pytest.mark.parametrize("sql", READS)
def test_reads_pass(spark, sql):
    assert_read_only(spark, sql)


@pytest.mark.parametrize("sql", WRITES)
def test_all_else_is_refused(spark, sql):
    with pytest.raises(NotReadOnly):
        assert_read_only(spark, sql)


def ids(spark, sql, **options):
    return {f.check for f in check(spark, sql, **options)}


@pytest.mark.parametrize(
    "sql, found, clean",
    [
        ("SELECT * FROM a.b.t", "S-STAT-001", "SELECT count(*) FROM a.b.t"),
        ("SELECT x FROM t, u", "S-STAT-002", "SELECT x FROM t, u WHERE t.a = u.a"),
        ("SELECT x FROM t INNER JOIN u", "S-STAT-002", "SELECT x FROM t CROSS JOIN u"),
        ("SELECT x FROM t WHERE a NOT IN (SELECT a FROM u)", "S-STAT-003", "SELECT x FROM t WHERE a IN (SELECT a FROM u)"),
        ("SELECT x FROM t WHERE n = '1'", "S-STAT-004", "SELECT x FROM t WHERE n = 1"),
        ("SELECT x FROM t WHERE upper(n) = m", "S-STAT-005", "SELECT x FROM t WHERE n = m"),
        ("SELECT x FROM t WHERE d > '2024-01-31'", "S-STAT-006", "SELECT x FROM t WHERE d > 'soon'"),
        ("SELECT x FROM t JOIN u ON t.a = u.a", "S-STAT-008", "SELECT x FROM t INNER JOIN u ON t.a = u.a"),
        ("SELECT DISTINCT x FROM t INNER JOIN u ON t.a = u.a", "S-STAT-010", "SELECT DISTINCT x FROM t"),
        ("SELECT x FROM (SELECT x FROM t ORDER BY x) s", "S-STAT-011", "SELECT x FROM (SELECT x FROM t ORDER BY x LIMIT 5) s"),
        ("SELECT t.x FROM t LEFT JOIN u ON t.a = u.a WHERE u.b > 1", "S-STAT-014", "SELECT t.x FROM t LEFT JOIN u ON t.a = u.a WHERE u.b IS NULL"),
        ("SELECT sum(a / b) AS r FROM t", "D-ADD-001", "SELECT sum(a) / sum(b) AS r FROM t"),
    ],
)
def test_findings(spark, sql, found, clean):
    assert found in ids(spark, sql)
    assert found not in ids(spark, clean)


def test_named_layers(spark):
    sql = "WITH s AS (SELECT a FROM prod.core.t) SELECT a FROM s INNER JOIN dev.sandbox_x.u ON s.a = u.a"
    assert ids(spark, sql, sandbox=["sandbox"], deprecated=["PROD.core.T"], certified=["dev.sandbox_x.u"]) == {"S-STAT-012", "S-STAT-007", "S-META-004"}
    assert table_names(spark, sql) == ["prod.core.t", "dev.sandbox_x.u"] or set(table_names(spark, sql)) == {"prod.core.t", "dev.sandbox_x.u"}


def test_lineage_and_keys(spark, sf_dir):
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    df = spark.sql("WITH b AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_name, total * 2 AS twice, 1 AS one FROM b INNER JOIN customer ON o_custkey = c_custkey")
    assert column_sources(df) == {"c_name": ["customer.c_name"], "twice": ["orders.o_totalprice"], "one": []}
    assert mismatched_keys(spark, "SELECT 1 AS x FROM orders INNER JOIN customer ON o_custkey = c_name")
    assert not mismatched_keys(spark, "SELECT 1 AS x FROM orders INNER JOIN customer ON o_custkey = c_nationkey")
    facts = scan_facts(spark.table("orders").filter("o_orderkey > 5").select("o_custkey"))
    assert "GreaterThan(o_orderkey,5)" in facts[0]["PushedFilters"] and "o_totalprice" not in facts[0]["ReadSchema"]
