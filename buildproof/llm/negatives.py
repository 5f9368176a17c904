"""Hard-negative mining: candidate blocks along a Hilbert curve, zone maps, and interval bounds that choose the blocks to read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, discard, discard_since, in_tasks, stage, staged_now
from .integer_vectors import NO_ID, Best, axes_for, integer_vectors, least_ids, matrix, matrix_of, narrowest, norms, principal_axes, products

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Axes of the Hilbert curve and bits of each.
CURVE_AXES, CURVE_BITS = 8, 7
#: Bytes of the vectors of a block and of a group of anchors (as int16); blocks read together, zone maps looked at together, and blocks that each group reads first.
BLOCK, GROUP, SLICE, ZONES, SEEDS = 128 << 10, 512 << 10, 32, 1024, 4
#: Rows of a group that are multiplied with a block at a time.
ROWS = 512


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows) with coordinates of `bits` bits; at most 63 bits in all. After Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    if not n:
        return np.zeros(points.shape[0], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the excess work
        low = bit - 1
        for k in range(n):
            on = (x[k] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, n):  # Gray code
        x[k] ^= x[k - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = out << 1 | (x[k] >> b) & 1
    return out


def curve_place(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Place of unit vectors along the curve through the leading axes."""
    near = unit @ axes[:, :CURVE_AXES]
    return hilbert(np.clip((near + 1) * (1 << (CURVE_BITS - 1)), 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def bounds(a: np.ndarray, rest: np.ndarray, low: np.ndarray, high: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with anything in each box, by interval arithmetic.

    a, low, high: coordinates on the axes; rest, far: length of what is left of the rows, and the greatest such length in the boxes.
    """
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    left = np.multiply.outer(rest, far)
    slack = 1e-9 * (1 + np.multiply.outer(np.abs(a).sum(1) + rest, np.maximum(np.abs(low), np.abs(high)).max(1, initial=0) + far))
    return up @ low.T + down @ high.T - left - slack, up @ high.T + down @ low.T + left + slack


def _along(q: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the axes, and the length of what is left of each row."""
    on = q @ axes
    return on, norms(q - on @ axes.T) if axes.shape[1] < axes.shape[0] else np.zeros(len(q))


def _ids(column) -> bytes:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes()


def _places(column) -> bytes:
    return np.stack([column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype("<i8").tobytes()


def _along_curve(vectors: DataFrame, axes: dict, size: int) -> DataFrame:
    """Rows with `part` (long): chunks of about `size` bytes of one dimension, neighbours by label and then along the curve. Ties are dealt by hash, so a common vector fills many chunks."""

    def place(batches):
        for b in batches:
            dims, at, q = b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64), b.column(0).to_pylist()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                m = matrix_of([q[i] for i in mine], int(dim))
                size_of = norms(m)
                at[mine] = curve_place(m / np.where(size_of > 0, size_of, 1)[:, None], axes_for(axes, int(dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "curve"])

    names = [c for c in vectors.columns if c not in ("q", "dim")]
    rows = vectors.select("q", "dim", *names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = in_tasks(rows, place, f"{kinds}, curve long").withColumn("_tie", F.xxhash64(ROW))
    total = vectors.agg(F.sum(2.0 * F.col("dim")).alias("bytes")).first().bytes or 0
    order = ["dim", "label", "curve", "_tie"]
    rows = rows.repartitionByRange(max(1, min(4096, int(total / (16 * size)) + 1)), *order).sortWithinPartitions(*order).drop("_tie", "curve")

    def number(batches):
        part, used, last = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for k, dim in enumerate(b.column(1).to_pylist()):
                if dim != last or used >= max(16, size // (2 * max(1, dim))):
                    part, used, last = part + 1, 0, dim
                out[k], used = part, used + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "part"])

    return in_tasks(rows, number, f"{kinds}, part long")


BLOCK_SCHEMA = "block long, dim long, rows long, label_low long, label_high long, low binary, high binary, far double, width long, ids binary, places binary, labels binary, vectors binary"


def blocks_of(vectors: DataFrame, axes: dict, size: int = BLOCK) -> DataFrame:
    """Candidate blocks along the curve, one row each: its zone map (least and greatest coordinate on every axis, and label) beside its rows as bytes."""

    def blob(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        q, labels = matrix_of(table.column("q").to_pylist(), dim), table.column("label").to_numpy().astype("<i8")
        on, rest = _along(q, axes_for(axes, dim))
        width, vectors_ = narrowest(q)
        ids, places = _ids(table.column("id").combine_chunks()), _places(table.column(ROW).combine_chunks())
        made = [table.column("part")[0].as_py(), dim, len(q), labels.min(), labels.max(), on.min(0).tobytes(), on.max(0).tobytes(), rest.max(), width, ids, places, labels.tobytes(), vectors_]
        return pa.table({n: [x] for n, x in zip((x.split()[0] for x in BLOCK_SCHEMA.split(", ")), made)})

    return _along_curve(vectors, axes, size).groupBy("part").applyInArrow(blob, BLOCK_SCHEMA)


def _groups(anchors: DataFrame) -> DataFrame:
    """One row for each group of anchors. anchors: ROW, label, dim, q, part, and arrays low, high, floor with a score window each."""

    def blob(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        width, vectors = narrowest(matrix_of(table.column("q").to_pylist(), dim))
        windows = [np.array([x.as_py() for x in table.column(n)], "<i8").tobytes() for n in ("low", "high", "floor")]
        labels = table.column("label").to_numpy().astype("<i8").tobytes()
        made = [table.column("part")[0].as_py(), dim, table.num_rows, width, _places(table.column(ROW).combine_chunks()), labels, *windows, vectors]
        return pa.table({n: [x] for n, x in zip(("g", "g_dim", "g_rows", "g_width", "g_places", "g_labels", "g_low", "g_high", "g_floor", "g_vectors"), made)})

    return anchors.groupBy("part").applyInArrow(blob, "g long, g_dim long, g_rows long, g_width long, g_places binary, g_labels binary, g_low binary, g_high binary, g_floor binary, g_vectors binary")


class _Group:
    """The anchors of a group, as read from its row."""

    def __init__(self, r: dict, axes: dict):
        n, self.dim = r["g_rows"], r["g_dim"]
        self.q = matrix(r["g_vectors"], r["g_width"], n, self.dim)
        self.places, self.labels = np.frombuffer(r["g_places"], "<i8").reshape(n, 2), np.frombuffer(r["g_labels"], "<i8")
        self.low, self.high, self.floor = (np.frombuffer(r[f"g_{x}"], "<i8").reshape(n, -1) for x in ("low", "high", "floor"))
        self.on, self.rest = _along(self.q, axes_for(axes, self.dim))

    def need(self, zones: list[dict], same: bool, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors (rows) must read which blocks (columns), and the middle of their score intervals."""
        low, high = (np.stack([np.frombuffer(z[x], np.float64) for z in zones]) for x in ("low", "high"))
        least, most = bounds(self.on, self.rest, low, high, np.array([z["far"] for z in zones]))
        first, last = (np.array([z[x] for z in zones]) for x in ("label_low", "label_high"))
        mine = self.labels[:, None]
        open_ = (first <= mine) & (mine <= last) if same else (first != mine) | (last != mine)
        hit = np.zeros_like(open_)
        for j in range(self.low.shape[1]):  # an empty window (low > high) needs nothing
            hit |= (self.low[:, j] <= self.high[:, j])[:, None] & (most >= np.maximum(self.low[:, j], floor[:, j])[:, None]) & (least <= self.high[:, j][:, None])
        return open_ & hit, (least + most) / 2


def _plan(groups: DataFrame, zones: DataFrame, axes: dict, same: bool) -> DataFrame:
    """g, block, promise: every block that some window of a group must read, from zone maps alone."""
    n = zones.count()
    stacked = zones.withColumn("pile", F.pmod(F.xxhash64("block"), F.lit(n // ZONES + 1))).groupBy("dim", "pile").agg(F.collect_list(F.struct("block", "label_low", "label_high", "low", "high", "far")).alias("zones"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                group = _Group(r, axes)
                must, middle = group.need(r["zones"], same, group.floor)
                at = np.flatnonzero(must.any(0))
                promise = np.where(must, middle, 0.0)[:, at].sum(0) / np.maximum(must[:, at].sum(0), 1)
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(at), pa.int64()), pa.array([r["zones"][i]["block"] for i in at], pa.int64()), pa.array(promise, pa.float64())], ["g", "block", "promise"])

    return in_tasks(groups.join(stacked, groups.g_dim == stacked.dim), run, "g long, block long, promise double")


def _visit(need: DataFrame, groups: DataFrame, blocks: DataFrame, axes: dict, same: bool, keep: int) -> DataFrame:
    """place, window, id, score: the first `keep` rows of every window of the anchors in the blocks needed. Slices of blocks meet their groups in one task each."""
    n = blocks.count()
    need = stage(need.select("g", "block", F.pmod(F.xxhash64("block"), F.lit(n // SLICE + 1)).alias("slice")), "need")
    read = need.join(blocks, "block")
    asked = need.select("g", F.col("slice").alias("part")).distinct().join(groups, "g").withColumnRenamed("g", "group")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Group(left.to_pylist()[0], axes)
        windows = group.low.shape[1]
        best = Best(np.maximum(group.floor, group.low).ravel(), keep)
        held = right.to_pylist()
        _, middle = group.need(held, same, group.floor)
        for k in np.argsort(-middle.max(0, initial=0)):
            block = held[k]
            rows_of = matrix(block["vectors"], block["width"], block["rows"], group.dim)
            labels, ids, places = np.frombuffer(block["labels"], "<i8"), np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["places"], "<i8").reshape(-1, 2)
            must = np.flatnonzero(group.need([block], same, best.floor.reshape(-1, windows))[0][:, 0])
            for start in range(0, len(must), ROWS):
                rows = must[start : start + ROWS]
                score = products(group.q[rows], rows_of)
                fits = (group.labels[rows, None] == labels) == same
                found = []
                for j in range(windows):
                    floor = best.floor.reshape(-1, windows)[rows, j][:, None]
                    i, c = np.nonzero(fits & (score >= floor) & (score <= group.high[rows, j][:, None]))
                    other = (group.places[rows[i]] != places[c]).any(1)
                    i, c = i[other], c[other]
                    found.append((rows[i] * windows + j, score[i, c], ids[c]))
                best.add(*(np.concatenate(x) for x in zip(*found)))
        place = pa.StructArray.from_arrays([pa.array(group.places[best.key // windows, x]) for x in (0, 1)], ["file", "index"])
        return pa.table({ROW: place, "window": pa.array(best.key % windows, pa.int32()), "id": pa.array(best.ids, mask=best.ids == NO_ID), "score": best.score})

    return asked.groupBy("group", "part").cogroup(read.groupBy("g", "slice")).applyInArrow(run, f"{ROW} {ROW_TYPE}, window int, id long, score long")


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy(ROW, "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def nearest(anchors: DataFrame, blocks: DataFrame, axes: dict, same: bool, keep: int) -> DataFrame:
    """place, window, rank, id, score: for every score window of every anchor the first `keep` rows of its own label (same) or of other labels.

    A few blocks that promise most are read first; they give each window the score that further rows must reach, and zone maps then tell which other blocks can hold such rows.
    """
    zones = blocks.select("block", "dim", "label_low", "label_high", "low", "high", "far")
    groups = stage(_groups(anchors.withColumn("floor", F.col("low"))), "anchors")
    by_promise = Window.partitionBy("g").orderBy(F.col("promise").desc(), "block")
    seeds = stage(_plan(groups, zones, axes, same).withColumn("_n", F.row_number().over(by_promise)).filter(F.col("_n") <= SEEDS).drop("_n"), "seeds")
    first = stage(_visit(seeds, groups, blocks, axes, same, keep), "first")
    known = _first(first, keep).filter(F.col("rank") == keep).groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
    reached = anchors.join(known, ROW, "left").withColumn("floor", F.expr("transform(low, (x, i) -> coalesce(try_element_at(known, i), x))")).drop("known")
    discard(groups)
    groups = stage(_groups(reached), "anchors")
    need = _plan(groups, zones, axes, same).join(seeds, ["g", "block"], "left_anti")
    found = stage(first.unionByName(_visit(need, groups, blocks, axes, same, keep)), "found")
    discard(groups, seeds, first)
    return found


def hard_negatives(
    table: DataFrame, label: Column, anchors: Column, vector: str = "embedding", id_col: str = "vec_id", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label: an integer column of the table; anchors: a condition on id. Components become floor(scale * x); scores are exact. An anchor's positives are its
    first `positives` other rows of its label, by descending score, then id (null last); for each of them the first `negatives` rows of other labels whose score lies
    between low and high percent of the positive's. Where there are fewer, there are fewer rows; a negative positive_score has an empty window.
    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of another length aren't compared. Rows that repeat an id are rows of
    their own, as anchors too; other columns are ignored; an empty table gives no rows. Ids are longs below 2^63 - 1.
    """
    before = staged_now()
    vectors = stage(integer_vectors(table, scale, vector, id_col, label=label.cast("long")).filter("label is not null"), "vectors")
    axes = principal_axes(vectors)
    blocks = stage(blocks_of(least_ids(vectors, max(positives + 1, negatives), "label"), axes, block), "blocks")
    end = F.lit((1 << 63) - 1).cast("long")
    asked = stage(_along_curve(vectors.filter(anchors), axes, group), "asked")
    near = nearest(asked.select(ROW, "label", "dim", "q", "part", F.array(-end).alias("low"), F.array(end).alias("high")), blocks, axes, True, positives)
    pairs = stage(_first(near, positives).select(ROW, F.col("rank").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    discard(near)
    # exact where 100 times a score would not fit a long
    score = F.col("positive_score").cast("decimal(38,0)")
    floor, top = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    sorted_ = F.array_sort(F.collect_list(F.struct("at", F.coalesce(floor, end).alias("lo"), F.coalesce(top, -end).alias("hi"))))
    held = pairs.groupBy(ROW).agg(sorted_.alias("w"))
    # windows that an anchor lacks are empty
    fill = lambda name, lacking: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("w", i)[name], lacking))
    windows = asked.join(held, ROW).select(ROW, "label", "dim", "q", "part", fill("lo", end).alias("low"), fill("hi", -end).alias("high"))
    found = nearest(windows, blocks, axes, False, negatives)
    ranked = _first(found, negatives).select(ROW, (F.col("window") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select(ROW, F.col("id").alias("anchor_id"))
    out = stage(pairs.join(ranked, [ROW, "at"]).join(ids, ROW).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard_since(before, out)
    return out
