import numpy as np
from pyspark.sql import functions as F

from buildproof.llm.toxicity import best_threshold, classify, features


def test_held_out_toxicity(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = classify(docs, labels.filter(~apart)).join(labels.filter(apart), "doc_id").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in found)
    assert hit >= 0.92 * sum(r.toxic for r in found) and hit >= 0.92 * sum(r.is_toxic for r in found)
    poor = sum(r.is_poor == (r.quality == 0) for r in found)
    assert poor >= 0.95 * len(found)


def test_edge_cases(spark):
    rows = [(i, f"nice words here {i}") for i in range(40)] + [(100 + i, f"you awful fool {i}") for i in range(40)] + [(500, None), (501, ""), (502, "?!"), (None, "awful fool"), (503, "kind " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows[:80]] + [(500, 0, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[i].is_toxic == (i >= 100) for i in range(40)) and all(got[100 + i].is_toxic for i in range(40))
    assert got[None].is_toxic and not any(got[i].is_toxic or got[i].p_toxic for i in (500, 501, 502))
    assert classify(docs.limit(0), labels).count() == 0
    assert not any(r.is_toxic for r in classify(docs, labels.limit(0)).collect())


def test_threshold_and_features():
    assert best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == 0.55
    assert len(features(b"The the THE")[0]) == 2 and len(features(None)[0]) == 0


def test_sparse_chain_matches_a_dense_one():
    """Every step of the chain with plain dense matrices: out-of-fold inputs in training, earlier probabilities in prediction."""
    import numpy as np

    from buildproof.llm.toxicity import BUCKETS, FOLDS, Chain, Linear, features

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "bad", "vile", "text", "word", "more"], 4)) for _ in range(90)]
    labels = np.array([[int("bad" in t), int("vile" in t and "bad" in t)] for t in texts])
    made = [features(t.encode()) for t in texts]
    docs, shape = [m[0] for m in made], np.array([m[1] for m in made])
    chain = Chain().fit(docs, shape, labels, ["a", "b"])

    def dense(model, d, x):
        row = np.zeros(BUCKETS)
        row[d] = 1
        weights = np.zeros(BUCKETS)
        weights[model.buckets] = model.w
        return 1 / (1 + np.exp(-(row @ weights + ((x - model.mean) / model.spread) @ model.v + model.bias)))

    fold = np.random.default_rng(3).permutation(len(docs)) % FOLDS
    unseen = np.zeros(len(docs))
    for f in range(FOLDS):
        inside = np.flatnonzero(fold != f)
        model = Linear().fit([docs[i] for i in inside], shape[inside], labels[inside, 0])
        for i in np.flatnonzero(fold == f):
            unseen[i] = dense(model, docs[i], shape[i])
    second = Linear().fit(docs, np.column_stack((shape, unseen)), labels[:, 1])
    assert np.allclose(second.w, chain.models[1].w) and np.allclose(second.v, chain.models[1].v)
    got = chain.probas(docs, shape)
    for k, d in enumerate(docs):
        a = dense(chain.models[0], d, shape[k])
        assert np.allclose(got[k], [a, dense(chain.models[1], d, np.append(shape[k], a))])
    assert ((got[:, 0] > 0.5) == labels[:, 0]).mean() > 0.95
