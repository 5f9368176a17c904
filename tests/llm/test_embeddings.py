import numpy as np

from buildproof.llm.embeddings import axes_of, compare, near_vectors


def brute(rows):
    ids, good = [r[0] for r in rows], {}
    for k, (_, v) in enumerate(rows):
        a = np.array([np.nan if x is None else x for x in v or []], float)
        if len(a) and np.isfinite(a).all() and a.any():
            good[k] = a / np.linalg.norm(a)
    label, links = list(range(len(rows))), [0] * len(rows)
    pairs = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    comp = [min(ids[j] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    return sorted((ids[i], links[i], comp[i]) for i in range(len(rows)))


def fixture(n=700, dim=24):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centers[k % 12] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 2.0])
        rows.append((1000 - k, [float(np.float32(x)) for x in v]))
    hot = rows[0][1]
    rows += [(2000 + k, hot) for k in range(200)] + [(3000, [2 * x for x in hot]), (3001, [-x for x in hot])]
    return rows + [(4000, None), (4001, []), (4002, [0.0] * dim), (4003, [float("nan")] * dim), (4004, [None] * dim), (4005, [1.0, 2.0]), (4006, [2.0, 4.0]), (3000, hot)]


def test_links_match_brute_force(spark):
    rows = fixture()
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    for tile in (4096, 100):
        got = sorted((r.id, r.n_links, r.component_id) for r in near_vectors(table, tile=tile).collect())
        assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_no_rows_and_no_usable_vector(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(table.limit(0)).count() == 0


def test_many_tiles_hot_classes_and_chains(spark):
    """64 dimensions, clusters about the threshold, chains of links, a class with a third of all rows, ids that are texts."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(150, 64))
    made = [centers[k % 150] + rng.normal(size=64) * rng.choice([0.1, 0.2, 0.25, 0.3, 1.5]) for k in range(1600)]
    step = centers[0]
    for _ in range(40):
        step = step + rng.normal(size=64) * 0.2
        made.append(step)
    vectors = np.array(made + [made[5]] * 800, np.float32).astype(float)
    ids = [f"v{k:05d}" for k in rng.permutation(len(vectors))]
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.argsort(np.argsort(ids))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(label)).min(1))
        if (low == label).all():
            break
        label = low
    want = sorted((i, int(n), sorted(ids)[k]) for i, n, k in zip(ids, near.sum(1), label))
    assert 100 < near.sum() and len(set(label)) < len(ids) - 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id string, embedding array<double>")
    for tile in (None, 64):
        assert sorted((r.id, r.n_links, r.component_id) for r in near_vectors(table, tile=tile).collect()) == want


def test_blocks_stop_early():
    rng = np.random.default_rng(2)
    spread = np.exp(-np.arange(64) / 6)  # most variance in a few axes, as embeddings have it
    x = rng.normal(size=(3000, 64)) * spread
    x[1] = x[0] * 1.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = []
    i, j = compare(x, x, axes_of(x, 64), 0.95, True, seen)
    want = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and (0, 1) in set(zip(i.tolist(), j.tolist()))
    assert max(seen) < 1 and min(seen) <= 0.25
