"""The queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB twin where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .common import small_batches

    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op6_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
           row_number() OVER w = 1 AS kept,
           text_sha256
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query("op5_bpe_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "joins",
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")


@query(
    "op10_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    n AS (SELECT doc_id, lines, unnest([1, 2, 3]) AS n FROM l),
    w AS (SELECT doc_id, lines, n, unnest(range(0, len(lines) - n + 1)) AS start FROM n WHERE len(lines) >= n),
    p AS (SELECT doc_id, start, n, array_to_string(lines[start + 1:start + n], chr(10)) AS part FROM w),
    k AS (SELECT * FROM p WHERE n = 3 OR len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) >= 50),
    later AS (SELECT doc_id, start, n FROM k QUALIFY row_number() OVER (PARTITION BY n, part ORDER BY doc_id, start) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM later),
    e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM l),
    s AS (SELECT e.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
                 coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE gone.i IS NULL), '') AS kept
          FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
    SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM s
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    found = drop_repeated_lines(table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("id") % 50 == 0)


@query("op12_exact_topk")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))
