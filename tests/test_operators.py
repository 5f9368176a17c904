from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from buildproof.functions.pii import card_numbers, hide, safe_sample
from buildproof.operators.assertions import duplicate_groups, orphans, outside_domain, per_column, null_count
from buildproof.operators.parity import compare_grain, compare_rows, compare_schemas, grain_groups, key_text, row_hash
from buildproof.operators.regression import added_rows, fingerprint, fingerprint_breaches, removed_rows, row_changes, schema_changes

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
rows = st.lists(st.tuples(st.integers(0, 2) | st.none(), st.sampled_from(["a", "b", None])), max_size=8)


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v string")


@few
@given(rows, rows)
def test_multiset_difference(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    want = Counter(a) - Counter(b), Counter(b) - Counter(a)
    assert Counter(map(tuple, added_rows(x, y).collect())) == want[0]
    assert Counter(map(tuple, removed_rows(x, y).collect())) == want[1]
    changes = {(r.__getitem__("__change"), r.k, r.v): r["__times"] for r in row_changes(x, y).collect()}
    assert changes == {("added", *k): n for k, n in want[0].items()} | {("removed", *k): n for k, n in want[1].items()}


def test_diff_takes_maps_and_schema_case(spark):
    x = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert added_rows(x, x.limit(1)).count() == 1 and row_changes(x, x).count() == 0
    assert schema_changes(spark.range(1).withColumnRenamed("id", "ID"), spark.range(1)) == ([], [])


def test_nulls_in_assertions(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (None, None), (None, None), (2, "x")])
    assert {(r.k, r.dup_count) for r in duplicate_groups(df, ["k"]).collect()} == {(1, 2), (None, 2)}
    assert [r.k for r in orphans(df, "k", frame(spark, [(1, ""), (None, "")]), "k").collect()] == [2]
    assert df.agg(outside_domain(df, "k", ["1", "abc"])).first()[0] == 1 and df.agg(outside_domain(df, "k", [])).first()[0] == 3
    assert df.agg(outside_domain(df, "v", ["a", None])).first()[0] == 0
    assert {(r.col_name, r.nulls, r.rate) for r in per_column(df, ["k", "v"], null_count, "nulls").collect()} == {("k", 2, 0.4), ("v", 2, 0.4)}
    assert per_column(df.limit(0), ["k"], null_count, "nulls").first().rate is None


def test_row_hash_tells_moved_nulls_and_ignores_types_of_a_category(spark):
    a = spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS x, 'a' AS y, 5 AS n")
    b = spark.sql("SELECT 1 AS k, 'a' AS x, CAST(NULL AS STRING) AS y, 5 AS n")
    c = spark.sql("SELECT CAST(1 AS DECIMAL(20,0)) AS k, CAST(NULL AS STRING) AS x, 'a' AS y, 5L AS n")
    h = lambda df: df.select(row_hash(df, df.columns)).first()[0]
    assert h(a) != h(b) and h(a) == h(c)
    assert [r.state for r in compare_rows(a, b, ["k"]).collect()] == ["mismatch"] and compare_rows(a, c, ["k"]).count() == 0
    assert compare_schemas(a, c) == [] and compare_schemas(a, a.selectExpr("k", "x", "n AS y")) == [("y", "text became numeric"), ("n", "missing")]


def test_key_text_and_grain(spark):
    df = spark.sql("SELECT CAST(v AS DOUBLE) AS d FROM VALUES (5.0), (5.5), (1e20), (NULL) AS t(v)")
    assert {r[0] for r in df.select(key_text(df, "d")).collect()} == {"5", "5.5", "100000000000000000000", "∅"}
    old, new = frame(spark, [(1, "a"), (1, "a"), (2, None)]), frame(spark, [(1, "a"), (3, "b")])
    found = {(r.k, r.state) for r in compare_grain(grain_groups(old, ["k", "v"]), grain_groups(new, ["k", "v"]), ["k", "v"], 0.1).collect()}
    assert found == {("1", "mismatch"), ("2", "missing"), ("3", "extra")}
    assert grain_groups(old, ["k"], top=1).collect()[0].group_count == 2


def test_personal_data(spark):
    df = spark.createDataFrame([("write to a.b@c.org or 078-05-1120", "Ann", "pay 4111 1111 1111 1111"), (None, None, "4111 1111 1111 1112")], "t string, first_name string, c string")
    assert df.select(hide(df.t).alias("t")).first().t == "write to [hidden] or [hidden]"
    assert [r.n for r in df.select(card_numbers(df.c).alias("n")).collect()] == [["4111111111111111"], []]
    shown = [tuple(r) for r in safe_sample(df, 5).collect()]
    assert shown == [("write to [hidden] or [hidden]", "[hidden]", "[hidden]"), (None, None, "4111 1111 1111 1112")]
    assert safe_sample(df, 5, aggregate_only=True).count() == 0


def test_sums_keep_small_values(spark):
    rates = spark.range(1000).selectExpr("id", "0.004 + id * 1e-7 AS rate", "id * 1e-20 AS tiny")
    found = {r.name: r.value for r in fingerprint(rates).collect()}
    assert abs(found["sum:rate"] - (4 + 499500e-7)) < 1e-12 and abs(found["sum:tiny"] / 499500e-20 - 1) < 1e-12
    moved = rates.selectExpr("id", "rate * 0.5 AS rate", "tiny * 2 AS tiny")
    assert {r.name for r in fingerprint_breaches(fingerprint(moved), fingerprint(rates), 0.01).collect()} == {"sum:rate", "sum:tiny"}
    again = rates.repartition(7).orderBy(rates.tiny.desc())
    assert fingerprint_breaches(fingerprint(again), fingerprint(rates)).count() == 0


def test_sums_of_values_too_large_for_decimals(spark):
    large = spark.sql("SELECT CAST(v AS DOUBLE) AS v FROM VALUES ('1e30'), ('2e300'), ('5'), ('NaN'), (NULL) AS t(v)")
    assert {r.name: r.value for r in fingerprint(large).collect()} == {"__row_count": 5, "sum:v": 2e300, "count:v": 4}
    assert fingerprint(large.limit(0)).filter("name = 'sum:v'").first().value == 0
    floats = spark.sql("SELECT CAST(0.5 AS FLOAT) AS f, CAST(0.001 AS DECIMAL(9,3)) AS d, CAST(3 AS TINYINT) AS i")
    assert {r.name: r.value for r in fingerprint(floats).filter("name like 'sum%'").collect()} == {"sum:f": 0.5, "sum:d": 0.001, "sum:i": 3}
