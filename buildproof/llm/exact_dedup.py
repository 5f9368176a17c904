"""Exact dedup by progressive refinement: length, then a hash of a prefix, then the full hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ROW, apart, numbered, settled, stage, whole_rows

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def text_keys(docs: DataFrame, text: str = "text", id_col: str = "doc_id", full: bool = False) -> DataFrame:
    """One narrow row per document: number, id, code points, length and prefix hash of the normalised text (and its full hash)."""
    norm = normalised(F.col(text))
    columns = [
        F.col(ROW),
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
        F.octet_length(norm).cast("long").alias("len"),
        F.xxhash64(F.octet_length(norm), F.substring(norm, 1, PREFIX_CHARS)).alias("pre"),
    ]
    return docs.select(*columns, *([F.sha2(norm.cast("binary"), 256).alias("full")] if full else []))


def survivors(keys: DataFrame) -> DataFrame:
    """Rows whose length, and then whose length and prefix hash, occur more than once.

    Each refinement counts with partial sums and joins the shared keys back; the joins are plain
    shuffles that adaptive execution can split, so one length or prefix may hold a third of all rows.
    """
    for key in ("len", "pre"):
        shared = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
        keys = keys.join(apart(shared, key), key, "left_semi")
    return keys


def copy_groups(alive: DataFrame) -> DataFrame:
    """One row per group of equal texts: its full hash, its size and the number and id of the row that stays."""
    first = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(ROW).alias("row"))
    groups = alive.groupBy("full").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
    groups = groups.filter("group_size > 1").select("full", "group_size", F.col("first.row").alias("keep_row"), F.col("first.id").alias("keep_id"))
    return apart(groups, "full")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Group of every document, with the digest of its normalised text.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty. The row
    with the most code points, then the smallest id (null last), then the least place in the table stays.
    Returns __row, id, keep_id, group_size, kept, full. An empty table gives no rows; columns with other
    names are ignored. Since the digest of every row is asked for, the full hash is taken in the one scan.
    """
    keys = stage(text_keys(numbered(settled(docs)), text, id_col, full=True), "text-keys")
    groups = copy_groups(survivors(keys))
    joined = keys.join(groups, "full", "left")
    return joined.select(
        ROW,
        "id",
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col(ROW), F.lit(True)).alias("kept"),
        "full",
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without the copies that exact_groups() drops; all columns stay as they are, whatever their names.

    Only survivors of the length and prefix stages have their text read again for the full hash. Rows that repeat
    an id are documents of their own; an empty table gives no rows.
    """
    docs = settled(docs)
    rows = numbered(docs)
    alive = survivors(stage(text_keys(rows, text, id_col), "text-keys"))
    texts = rows.select(ROW, F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("full"))
    alive = alive.join(texts, ROW)
    losers = alive.join(copy_groups(alive), "full").filter(F.col("keep_row") != F.col(ROW)).select(ROW)
    return whole_rows(docs).join(losers, ROW, "left_anti").select("doc.*")
