import numpy as np
from pyspark.sql import functions as F

from buildproof.llm.integer_vectors import Best, axes_for, norms, products
from buildproof.llm.registry import QUERIES
from buildproof.llm.topk import LEAST, search, top_products

BIG = 1 << 62


def scaled(v, scale):
    """The integers of a vector, or None where it takes no part."""
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(scale * float(x))) for x in v]


def brute(rows, every, top=10):
    """query_id, rank, vec_id, score in plain integers. rows: (id, vector)."""
    known = [(i, q) for i, v in rows if (q := scaled(v, 1024)) is not None]
    out = []
    for a, (qid, q) in enumerate(known):
        if qid is None or qid % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, c)), BIG if cid is None else cid, cid) for b, (cid, c) in enumerate(known) if a != b and len(c) == len(q)]
        out += [(qid, n + 1, cid, -s) for n, (s, _, cid) in enumerate(sorted(found, key=lambda x: x[:2])[:top])]
    return sorted(out, key=lambda r: (r[0], r[1], BIG if r[2] is None else r[2], r[3]))


def fixture():
    rng = np.random.default_rng(6)
    length = np.exp(rng.normal(size=600))  # lengths that differ make most of them useless as candidates
    m = rng.normal(size=(600, 12)) * np.exp(-np.arange(12) / 3) * length[:, None]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(m)]
    rows += [(700 + k, rows[20][1]) for k in range(300)]  # one vector holds a third of all rows
    rows += [(20, rows[20][1]), (20, rows[3][1]), (None, rows[20][1]), (None, rows[9][1])]  # repeated and null ids
    odd = [None, [None] * 12, [float("nan")] * 12, [1.0, float("inf")] + [0.0] * 10, [0.0] * 12, [], [], [2.0, -1.0], [1.5, 3.0], [0.0, 0.0], [-2.0, -2.0]]
    return rows + [(2000 + 20 * k, v) for k, v in enumerate(odd)] + [(5000 + k, [3e30 * (k + 1)] * 3) for k in range(0, 40, 5)]


def got(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=lambda r: (r[0], r[1], BIG if r[2] is None else r[2], r[3]))


def test_first_rows_match_brute_force(spark):
    rows = fixture()
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, score string, norm double")
    want = brute([(i, v) for i, v in rows if not v or v[0] is None or abs(v[0]) < 1e29], 20)
    big = {i for i, v in rows if v and v[0] is not None and abs(v[0]) > 1e29}
    assert len(want) > 400
    for sizes in ({}, {"strip": 2048, "group": 512}):
        found = got(top_products(table, F.col("id") % 20 == 0, **sizes))
        assert [r for r in found if r[0] not in big] == want
        # products beyond a long count as its end, so that ties go by id
        assert [r[2:] for r in found if r[0] == 5000] == [(5000 + k, (1 << 63) - 1) for k in range(5, 40, 5)]


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(QUERIES["op12_exact_topk"](spark, sf_dir)) == brute(rows, 100)


def test_no_rows(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert top_products(table, F.col("id") % 100 == 0).count() == 0
    assert top_products(table.limit(0), F.col("id") % 100 == 0).count() == 0
    assert got(top_products(table, F.col("id") == 1)) == []


def test_short_vectors_and_far_axes_are_never_multiplied():
    rng = np.random.default_rng(3)
    c = np.floor(rng.normal(size=(6000, 32)) * np.exp(-np.arange(32) / 4) * 300 * np.exp(0.3 * rng.normal(size=(6000, 1))))
    c = c[np.argsort(-norms(c))]
    q = c[rng.choice(6000, 100, replace=False)]
    axes = np.linalg.svd(c / norms(c)[:, None], full_matrices=False)[2].T
    rows, places = np.arange(12000).reshape(-1, 2), np.full((100, 2), -1)
    seen = []
    best = search(q, places, np.full(100, LEAST), c, rows, np.arange(6000), axes, 10, seen)
    exact = products(q, c)
    want = [sorted((-int(exact[k, j]), j) for j in range(6000))[:10] for k in range(100)]
    assert [[(-int(s), int(i)) for s, i in zip(best.score[best.key == k], best.ids[best.key == k])] for k in range(100)] == want
    multiplied = sum(a * b for a, b, _ in seen)
    assert multiplied < 0.9 * q.shape[0] * len(c) and min(share for *_, share in seen) <= 0.5  # norms leave out the last, axes stop others early


def test_products_and_floors():
    a = np.array([[2.0**40, 1.0], [-(2.0**70), 3.0]])
    assert products(a, a).tolist() == [[(1 << 63) - 1, -(1 << 63)], [-(1 << 63), (1 << 63) - 1]]
    assert products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
    best = Best(np.array([5, LEAST]), 2)
    best.add(np.array([0, 0, 1]), np.array([7, 9, 1]), np.array([4, 4, 4]))
    best.add(np.array([0, 1]), np.array([9, 1]), np.array([3, 2]))
    assert (best.key.tolist(), best.score.tolist(), best.ids.tolist(), best.floor.tolist()) == ([0, 0, 1, 1], [9, 9, 1, 1], [3, 4, 2, 4], [9, 1])
    assert axes_for({}, 100).shape == (100, 64)
