"""Embedding near-dedup: tiles of vectors compared along their principal axes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, apart, arrow_map, discard_since, numbered, settled, stage, staged_now
from .components import components

THRESHOLD = 0.95
#: Bytes of the vectors of a tile, and rows of a tile compared at a time.
TILE, BLOCK = 8 << 20, 1024
#: Shares of all dimensions after each of which the pairs that can't reach the threshold are given up.
SHARES = (0.125, 0.25, 0.5, 1.0)
#: Axes that the boxes of cells are measured on. Axes and split points come from a sample of at most so many vectors, and of
#: so many bytes; a cell needs PER_CELL of them. They decide what is compared first, never what is found.
NEAR_AXES, SAMPLE, SAMPLE_BYTES, PER_CELL = 8, 20_000, 32 << 20, 8
#: Single-precision products are off by less than this for unit vectors.
SLACK = 1e-4


def vectors_of(table: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """__row, id, v (float bytes), dim, ok of every row. ok: not null, all finite, some component not zero."""
    rows = numbered(settled(table)).select(ROW, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def batch(b):
        column = b.column(2)
        at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        numbers = column.values.to_numpy(zero_copy_only=False) + 0.0  # null components become NaN; no negative zero
        out, dims, ok = [], [], []
        for k in range(b.num_rows):
            a = numbers[at[k] : at[k + 1]] if there[k] else numbers[:0]
            good = bool(len(a)) and bool(np.isfinite(a).all()) and bool(a.any())
            out.append(a.tobytes() if good else None)
            dims.append(len(a))
            ok.append(good)
        return {ROW: b.column(0), "id": b.column(1), "v": out, "dim": dims, "ok": ok}

    return arrow_map(rows, batch, f"{ROW} {ROW_TYPE}, id {rows.schema['id'].dataType.simpleString()}, v binary, dim int, ok boolean")


def _unit(column, dim: int) -> np.ndarray:
    """Rows of unit length from binary vectors; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_of(sample: np.ndarray, dim: int) -> np.ndarray:
    """Principal axes (columns, most variance first) of some unit vectors."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(dim)


def cells_of(sample: np.ndarray, cells: int) -> list:
    """A tree of medians over the leading axes: nested [axis, value, below, above], or a cell's number."""
    numbers = iter(range(cells))

    def split(points: np.ndarray, n: int):
        if n == 1 or len(points) < 2:
            return next(numbers)
        axis = int(points.var(0).argmax())
        value = float(np.median(points[:, axis]))
        below = points[:, axis] < value
        return [axis, value, split(points[below], n // 2), split(points[~below], n - n // 2)]

    return split(sample, cells)


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(points), tree, np.int64)
    axis, value, low, high = tree
    out, below = np.empty(len(points), np.int64), points[:, axis] < value
    out[below], out[~below] = cell_of(low, points[below]), cell_of(high, points[~below])
    return out


def _steps(dim: int) -> list[int]:
    return sorted({max(1, round(dim * share)) for share in SHARES})


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, seen: list | None = None):
    """Pairs (i, j) of unit rows of a and b with cosine >= threshold; i < j where the tiles are the same.

    Products are accumulated from the leading axes on. After each step, what the other axes can add is at most the product
    of the norms of the suffixes; a block in which no pair can reach the threshold is given up, rows and columns
    without such a pair are left out, and few such pairs are computed at once. All are, in double precision. seen: gets the share of axes that each block took.
    """
    ends = _steps(axes.shape[0])
    begins = [0, *ends[:-1]]
    ra, rb = a @ axes, b @ axes
    suffix = [[np.sqrt((r[:, e:] ** 2).sum(1)).astype(np.float32) for e in ends] for r in (ra, rb)]
    fa, fb = ra.astype(np.float32), rb.astype(np.float32)
    found_i, found_j = [], []
    for p in range(0, len(a), BLOCK):
        for q in range(p if same else 0, len(b), BLOCK):
            rows, cols = np.arange(p, min(p + BLOCK, len(a))), np.arange(q, min(q + BLOCK, len(b)))
            total = np.zeros((len(rows), len(cols)), np.float32)
            for k, (start, end) in enumerate(zip(begins, ends)):
                total += fa[rows, start:end] @ fb[cols, start:end].T
                open_ = total + np.multiply.outer(suffix[0][k][rows], suffix[1][k][cols]) >= threshold - SLACK
                i, j = np.nonzero(open_)
                if len(i) * 64 <= open_.size:
                    break
                wide, tall = open_.any(1), open_.any(0)
                if wide.mean() * tall.mean() < 0.5:
                    total = total[np.ix_(wide, tall)]
                    i, j = (np.cumsum(wide) - 1)[i], (np.cumsum(tall) - 1)[j]
                    rows, cols = rows[wide], cols[tall]
            if seen is not None:
                seen.append(end / axes.shape[0])
            i, j = rows[i], cols[j]
            if same:
                i, j = i[i < j], j[i < j]
            for start in range(0, len(i), 1 << 16):
                x, y = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
                hit = np.einsum("nd,nd->n", a[x], b[y]) >= threshold
                found_i.append(x[hit])
                found_j.append(y[hit])
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links with the least node it can reach by them, without that node itself."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _tiles(distinct: DataFrame, dim: int, threshold: float, tile: int) -> tuple[np.ndarray, DataFrame]:
    """Principal axes; and pair, side, node ids, copies and vectors of every pair of tiles that may hold a link.

    Cells are boxes on the leading axes, one for each tile's worth of vectors as far as the sample tells them
    apart; larger cells are cut into tiles by hash. Two cells further apart than the threshold allows are no pair.
    """
    n, most = distinct.count(), min(SAMPLE, SAMPLE_BYTES // (8 * dim))
    spot = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))
    sample = [bytes(r.v) for r in distinct.filter(spot).select("v").limit(2 * most).collect()]
    points = _unit(pa.array(sample, pa.binary()), dim) if sample else np.zeros((0, dim))
    axes, near_axes = axes_of(points, dim), min(NEAR_AXES, dim)
    lead = axes[:, :near_axes]
    tree = cells_of(points @ lead, max(1, min(len(sample) // PER_CELL, n // tile)))

    def place(b):
        at = _unit(b.column(2), dim) @ lead
        return {"node": b.column(0), "copies": b.column(1), "v": b.column(2), "cell": cell_of(tree, at), **{f"p{k}": at[:, k] for k in range(near_axes)}}

    placed = stage(arrow_map(distinct.select("node", "copies", "v"), place, "node long, copies long, v binary, cell long, " + ", ".join(f"p{k} double" for k in range(near_axes))), "placed")
    bounds = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(f"p{k}").alias(f"{name}{k}") for k in range(near_axes) for name, f in (("lo", F.min), ("hi", F.max))]).collect()
    parts = {r.cell: -(-r.n // tile) for r in bounds}
    low, high = np.array([[r[f"lo{k}"] for k in range(near_axes)] for r in bounds]), np.array([[r[f"hi{k}"] for k in range(near_axes)] for r in bounds])
    most = 2 - 2 * threshold + 1e-6  # squared distance of unit vectors at the threshold
    partners = {}
    for x, r in enumerate(bounds):
        gap = np.maximum(np.maximum(low - high[x], low[x] - high), 0)
        partners[r.cell] = [bounds[y].cell for y in np.flatnonzero((gap**2).sum(1) <= most)]
    size = F.element_at(F.create_map(*[x for c, k in parts.items() for x in (F.lit(c), F.lit(k))]), F.col("cell"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), size))

    def blob(table: pa.Table) -> pa.Table:
        cols = [np.asarray(table.column(c)).astype("<i8").tobytes() for c in ("node", "copies")]
        return pa.table({"cell": table.column("cell").slice(0, 1), "part": table.column("part").slice(0, 1), "nodes": [cols[0]], "copies": [cols[1]], "vectors": [b"".join(table.column("v").to_pylist())]})

    blobs = placed.select("cell", "part", "node", "copies", "v").groupBy("cell", "part").applyInArrow(blob, "cell long, part long, nodes binary, copies binary, vectors binary")

    def spread(b):
        out = {"pair": [], "side": [], "at": []}
        for k, (c, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            for other in partners[c]:
                for q in range(parts[other]):
                    pair = sorted([(c, p), (other, q)])
                    out["pair"].append(f"{pair}")
                    out["side"].append(int(pair[0] != (c, p)))
                    out["at"].append(k)
        at = pa.array(out.pop("at"), pa.int64())
        return out | {name: b.column(name).take(at) for name in ("nodes", "copies", "vectors")}

    return axes, arrow_map(blobs, spread, "pair string, side int, nodes binary, copies binary, vectors binary")


def tile_links(distinct: DataFrame, dim: int, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """kind, a, b: kind 0: node a has links to b vectors of other classes; kind 1: a and b belong together.

    distinct: node, copies, v. A pair of tiles gives at most one row of each kind per vector, however
    many links it finds.
    """
    axes, tiles = _tiles(distinct, dim, threshold, tile or max(256, TILE // (8 * dim)))

    def run(table: pa.Table) -> pa.Table:
        sides = {}
        for r in table.to_pylist():
            u = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
            u = u / np.abs(u).max(1, keepdims=True)
            sides[r["side"]] = (np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["copies"], "<i8"), u / np.sqrt((u * u).sum(1, keepdims=True)))
        same = len(sides) == 1
        (na, ca, ua), (nb, cb, ub) = sides[0], sides[0 if same else 1]
        i, j = compare(ua, ub, axes, threshold, same)
        found_a = np.bincount(i, weights=cb[j], minlength=len(na)).astype(np.int64)
        found_b = np.bincount(j, weights=ca[i], minlength=len(nb)).astype(np.int64)
        u, v = forest(na[i], nb[j])
        sums = [(n[f > 0], f[f > 0]) for n, f in ((na, found_a), (nb, found_b))]
        a = np.concatenate([*(s[0] for s in sums), u])
        b = np.concatenate([*(s[1] for s in sums), v])
        kind = np.concatenate((np.zeros(len(a) - len(u), np.int32), np.ones(len(u), np.int32)))
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("pair").applyInArrow(run, "kind int, a long, b long")


def near_vectors(table: DataFrame, vector: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """__row, id, n_links, component_id, kept of every vector.

    Equal vectors form a class that is compared once, so a group of copies may hold a third of all rows. A vector that
    is null, empty, zero or holds a null or non-finite component links with nothing; vectors of different length
    never link. component_id is the least id of a component; repeated ids count as vectors of their own. An empty
    table gives no rows; other columns are ignored.
    """
    rows = stage(vectors_of(table, vector, id_col), "vectors")
    classes = rows.filter("ok").groupBy("v", "dim").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written with its number
    before = staged_now()
    dims = [r.dim for r in classes.select("dim").distinct().collect()]
    found = None
    for dim in dims:
        part = tile_links(classes.filter(F.col("dim") == dim).select("node", "copies", "v"), dim, threshold, tile)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(ROW, "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "links")
    discard_since(before, found)
    degree = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("far"))
    roots = components(found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = classes.join(degree, "node", "left").join(roots, "node", "left").select("v", "copies", "least", F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = joined.join(apart(least, "root"), "root").select("v", (F.col("copies") - 1 + F.col("far")).alias("n_links"), "component_id")
    out = rows.join(joined, "v", "left")
    out = out.select(ROW, "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
