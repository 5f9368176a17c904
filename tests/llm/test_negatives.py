import numpy as np
import pytest
from pyspark.sql import functions as F

from buildproof.llm import negatives
from buildproof.llm.negatives import bounds, curve_place, hard_negatives, hilbert
from buildproof.llm.registry import QUERIES

from .test_topk import BIG, scaled


def brute(rows, every, low=50, high=95):
    """Tuples in the order of the columns, in plain integers. rows: (id, vector, label)."""
    known = [(i, q, y) for i, v, y in rows if y is not None and (q := scaled(v, 256)) is not None]
    out = []
    for a, (aid, q, y) in enumerate(known):
        if aid is None or aid % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, c)), BIG if i is None else i, i, z) for b, (i, c, z) in enumerate(known) if a != b and len(c) == len(q))
        for ps, _, pid, _ in [s for s in scored if s[3] == y][:5]:
            ps = -ps
            fits = [(i, -s) for s, _, i, z in scored if z != y and low * ps <= -100 * s <= high * ps]
            out += [(aid, pid, n + 1, i, ps, s) for n, (i, s) in enumerate(fits[:3])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fixture():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(9, 16))
    rows = []
    for k in range(700):
        v = centers[k % 9] * 0.3 + rng.normal(size=16) * rng.choice([0.02, 0.2])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 9 + rng.integers(0, 2)) % 6))
    rows += [(1000 + k, rows[50][1], rows[50][2] if k % 3 else 5) for k in range(400)]  # one vector of a third of all rows, under two labels
    rows += [(50, rows[50][1], 1), (100, rows[7][1], 2), (None, rows[50][1], 3), (None, rows[50][1], rows[50][2])]
    odd = [(None, 1), ([None] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), ([0.0] * 16, 1), ([0.0] * 16, 2), ([-1.0] * 16, 77), (rows[3][1], None), ([], 1), ([], 2), ([1.0, 2.0], 1), ([1.0, 1.9], 2), ([1.0, 2.1], 1), ([2.0, 0.0], 3)]
    return rows + [(5000 + 50 * k, v, y) for k, (v, y) in enumerate(odd)]


@pytest.mark.parametrize("sizes", [{}, {"block": 1024, "group": 512}])
def test_windows_match_brute_force(spark, sizes):
    rows = fixture()
    table = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], "vec_id long, embedding array<float>, label int, score string, rank int, part int")
    want = brute(rows, 50)
    assert len(want) > 100
    assert got(hard_negatives(table, F.col("label"), F.col("id") % 50 == 0, **sizes)) == want


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, 50)
    assert want and got(QUERIES["op11_hard_negatives"](spark, sf_dir)) == want


def test_no_rows(spark):
    table = spark.createDataFrame([(50, [1.0], None), (100, None, 1), (150, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    for rows in (table, table.limit(0)):
        assert hard_negatives(rows, F.col("label"), F.col("id") % 50 == 0).count() == 0


def test_curve_visits_every_place_by_single_steps():
    for n, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        at = hilbert(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    assert curve_place(np.zeros((3, 0)), np.zeros((0, 0))).tolist() == [0, 0, 0]


def test_bounds_hold_and_leave_blocks_out():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32))
    x = np.concatenate([c + rng.normal(size=(64, 32)) * 0.05 for c in centers])
    axes = np.linalg.svd(x, full_matrices=False)[2][:8].T  # fewer axes than dimensions, so that the rest counts
    on = x @ axes
    rest = np.linalg.norm(x - on @ axes.T, axis=1)
    boxes = on.reshape(20, 64, 8)
    low, high = bounds(on, rest, boxes.min(1), boxes.max(1), rest.reshape(20, 64).max(1))
    score = (x @ x.T).reshape(1280, 20, 64)
    assert (score.min(2) >= low).all() and (score.max(2) <= high).all()
    assert (high < np.sort(x @ x.T, 1)[:, -5:-4]).mean() > 0.5  # over half of the blocks can't hold one of the first five


def test_zone_maps_keep_blocks_from_being_read(spark, monkeypatch):
    """Clustered vectors: the plan leaves out most blocks, and what is left out is never joined."""
    read = []
    visit = negatives._visit

    def counted(need, groups, blocks, *more):
        read.append((need.count(), groups.count() * blocks.count()))
        return visit(need, groups, blocks, *more)

    monkeypatch.setattr(negatives, "_visit", counted)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(24, 16))
    rows = [(k, [float(np.float32(x)) for x in centers[k % 24] + rng.normal(size=16) * 0.03], k % 24 // 2) for k in range(2400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(hard_negatives(table, F.col("label"), F.col("id") % 50 == 0, block=1600, group=64)) == brute(rows, 50)
    assert sum(n for n, _ in read) < 0.5 * sum(n for _, n in read[1::2])
