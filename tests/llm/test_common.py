"""Operators on inputs that are no plain scan: each reading of such a table may give other rows in another order."""

import pytest
from pyspark.sql import functions as F

from buildproof.llm.common import ROW, discard_since, numbered, settled, staged_now
from buildproof.llm.exact_dedup import drop_copies, exact_groups
from buildproof.llm.html_text import extract
from buildproof.llm.line_dedup import drop_repeated_lines
from buildproof.llm.simhash import drop_near_copies, near_groups
from buildproof.llm.suffix_dedup import drop_repeats, remove_repeats


@pytest.fixture(scope="module")
def parquet(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs.parquet")
    texts = F.concat_ws(" ", *[F.concat(F.lit(f"w{j}_"), F.pmod(F.xxhash64(F.pmod("id", F.lit(500)), F.lit(j)), F.lit(10**9))) for j in range(30)])
    spark.range(2000).select(F.col("id").alias("doc_id"), texts.alias("text")).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def inputs(docs):
    return {
        "repartition": docs.repartition(7),
        "random": docs.filter(F.rand() < 2),
        "join": docs.join(docs.select("doc_id").distinct(), "doc_id"),
        "coalesce": docs.repartition(9).coalesce(2),
        "union": docs.filter("doc_id < 900").union(docs.filter("doc_id >= 900")),
    }


@pytest.mark.parametrize("kind", ["repartition", "random", "join", "coalesce", "union"])
def test_no_text_is_lost_whatever_the_input_is(spark, parquet, kind):
    docs, before = inputs(parquet)[kind], staged_now()
    conf = spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), spark.conf.get("spark.sql.files.minPartitionNum", None)
    kept = drop_copies(docs)
    assert (kept.count(), kept.select("text").distinct().count()) == (500, 500)
    if kind != "repartition":  # the others share what gives them their rows
        discard_since(before)
        return
    kept = drop_near_copies(docs)
    assert (kept.count(), kept.select("text").distinct().count()) == (500, 500)
    assert exact_groups(docs).filter("kept").count() == 500 and near_groups(docs).filter("id = component_id").count() == 500
    assert drop_repeats(docs).filter("length(text) > 0").count() == 0  # every text stands four times
    assert remove_repeats(docs).filter("n_bytes = n_removed").count() == 2000
    lines = docs.withColumn("text", F.regexp_replace("text", " ", "\n"))
    assert drop_repeated_lines(lines).filter("length(text) > 0").select("text").distinct().count() == 500
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example/"), "doc_id").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    assert extract(pages).select("text").distinct().count() == 500
    assert conf == (spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), spark.conf.get("spark.sql.files.minPartitionNum", None))
    discard_since(before)
    assert staged_now() == before


def test_places_do_not_follow_the_splits(spark, parquet):
    rows = numbered(settled(parquet)).select("doc_id", ROW)
    first = {r.doc_id: r[ROW] for r in rows.collect()}
    assert len(set(first.values())) == 2000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again = numbered(settled(parquet)).select("doc_id", ROW)
        assert again.rdd.getNumPartitions() > rows.rdd.getNumPartitions() and {r.doc_id: r[ROW] for r in again.collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
