import zlib

from pyspark.sql import functions as F

from buildproof.llm.langid import drop_unknown, fold, identify


def test_fold_is_crc32_of_the_id(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = [r for r in identify(docs).withColumn("f", fold(F.col("doc_id"))).collect() if r.f == 0]
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    rows = [(i, f"the quick brown fox number {i} jumps", "en", "a") for i in range(20)] + [(100 + i, f"der schnelle braune fuchs {i} springt", "de", "b") for i in range(20)]
    rows += [(50, None, "en", None), (51, "", None, None), (52, "123 !?", "en", ""), (53, "le renard " * 30_000, None, "x"), (None, "fox", None, "x"), (54, "z", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = {r.doc_id: r for r in identify(docs).collect()}
    assert {found[i].lang_pred for i in (50, 51, 52)} == {"und"} and found[53].lang_pred in ("en", "de") and found[None].lang_pred in ("en", "de")
    clashing = docs.selectExpr("doc_id", "text", "lang", "concat(score, '!') as score", "doc_id as lang_pred", "'own' as __row", "1 as letter")
    kept = drop_unknown(clashing)
    assert kept.columns == clashing.columns
    before = {r.doc_id: r for r in clashing.collect()}
    assert all(before[r.doc_id] == r for r in kept.collect())
    assert {50, 51, 52} & {r.doc_id for r in drop_unknown(docs).collect()} == set()
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("doc_id = 50")).collect()} == {"und"}


def test_without_labels_only_texts_without_letters_go(spark):
    rows = [(1, "the quick brown fox", None), (2, "ein Fuchs", None), (3, None, None), (4, "", None), (5, "123 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in drop_unknown(docs).collect()} == {1, 2}
    only_held_out = docs.withColumn("lang", F.when(fold(F.col("doc_id")) == 0, F.lit("en")))
    assert {r.doc_id for r in drop_unknown(only_held_out).collect()} == {1, 2}


def test_lookups_match_a_direct_convolution():
    import numpy as np

    from buildproof.llm.langid import FILTERS, WIDTHS, WINDOW, ByteNet

    rng = np.random.default_rng(4)
    net = ByteNet(["a", "b", "c"])
    net.p = {k: rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in net.p.items()}

    def direct(window):
        e, pooled = net.p["emb"][window].astype(float), []
        for w in WIDTHS:
            for f in range(FILTERS):
                pooled.append(max(sum(float(e[i + o] @ net.p[f"w{w}"][o][:, f]) for o in range(w)) for i in range(WINDOW - w + 1)))
        z = np.maximum(pooled, 0) @ net.p["out"] + net.p["bias"]
        p = np.exp(z - z.max())
        return p / p.sum()

    sizes = [0, 1, 255, 256, 257, 700]
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in sizes]
    got = net.texts_proba(np.concatenate(texts), np.concatenate(([0], np.cumsum(sizes))))
    for t, p in zip(texts, got):
        parts = [t[k : k + WINDOW] for k in range(0, len(t), WINDOW)]
        if parts:  # a whole text is the mean of its windows by their bytes
            want = sum(direct(np.pad(x, (0, WINDOW - len(x)))) * len(x) for x in parts) / len(t)
            assert np.abs(want - p).max() < 1e-4


def test_training_reads_whole_texts(spark):
    """Only the ends of long texts tell the languages apart."""
    same = "0 " * 3000
    rows = [(k, same + ("the quick brown fox jumps " if k % 2 else "der schnelle braune fuchs springt ") * 30, "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, "the quick fox", None), (101, "der braune fuchs", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(docs).filter("doc_id >= 100").collect()} == {100: "en", 101: "de"}


def test_a_text_without_majority_is_rejected(spark):
    rows = [(k, "the quick brown fox jumps over it " * 3 if k % 2 else "der schnelle braune fuchs springt weit " * 3, "en" if k % 2 else "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert drop_unknown(docs).count() == 60
    assert drop_unknown(docs, majority=1.1).count() == 0  # the prediction decides
