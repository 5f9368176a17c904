"""A corpus pipeline: each stage applies one operator to all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildproof.llm.common import discard_since, small_batches, stage, staged_now
from buildproof.llm.exact_dedup import drop_copies
from buildproof.llm.langid import drop_unknown
from buildproof.llm.packing import pack
from buildproof.llm.simhash import drop_near_copies
from buildproof.llm.suffix_dedup import drop_repeats

# Every stage takes any table with doc_id and text (the first one lang as well). Rows that repeat an id are documents of their own,
# ties go to the smaller id and then to one fixed row, further columns stay whatever their names, and an empty table gives no rows.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: null texts, texts without a letter and those of which no language has a majority go.

    Where no label was there to learn from, texts with a letter stay.
    """
    small_batches(spark)
    return drop_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space; a null text counts as empty."""
    small_batches(spark)
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; null and blank texts are one group."""
    small_batches(spark)
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes and more that occur anywhere else; shorter and null texts stay as they are."""
    small_batches(spark)
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; a null or empty text is the end token alone."""
    import public_tokenizers  # only this stage needs the files

    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: The stages use learned weights, byte spans and a packing program, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written as Parquet and read again. What a stage has left behind goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = staged_now()
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
        discard_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
