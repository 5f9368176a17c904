"""What the two searches by integer inner product share: exact vectors, axes of a sample, first rows of each key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, arrow_map, numbered, settled

#: Axes come from a sample of at most so many vectors and bytes. At most so many are used, the other dimensions are bounded by their norm;
#: a vector length with fewer sampled vectors than AXES has its own leading dimensions as axes. They decide what is read first, never what is found.
SAMPLE, SAMPLE_BYTES, AXES = 20_000, 32 << 20, 64
#: Stands for a null id within tasks, so that it comes after all others.
NO_ID = np.iinfo(np.int64).max
#: Integers below this are exact as doubles, and so are sums that stay below it.
EXACT = float(1 << 53)


def narrowest(q: np.ndarray) -> tuple[int, bytes]:
    """A matrix of integral doubles as little-endian int16 or int32, or as doubles where they are larger; and the bytes of one number."""
    most = np.abs(q).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return int(kind[2]), q.astype(kind).tobytes()


def matrix(blob: bytes, width: int, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, {2: "<i2", 4: "<i4", 8: "<f8"}[width]).reshape(rows, dim).astype(np.float64)


def matrix_of(blobs: list[bytes], dim: int) -> np.ndarray:
    """One matrix of vectors that each have their own width."""
    widths = np.array([len(b) // dim if dim else 2 for b in blobs])
    out = np.empty((len(blobs), dim))
    for width in set(widths.tolist()):
        mine = np.flatnonzero(widths == width)
        out[mine] = matrix(b"".join(blobs[i] for i in mine), width, len(mine), dim)
    return out


def norms(q: np.ndarray) -> np.ndarray:
    """Lengths of rows; scaled first, so that squares don't overflow."""
    most = np.abs(q).max(1, initial=0)
    scaled = q / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((scaled * scaled).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b as longs. Scores beyond the range of a long count as its ends."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), low), high) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def integer_vectors(table: DataFrame, scale: int, vector: str, id_col: str, **more: Column) -> DataFrame:
    """__row, id, dim, norm, q and more columns of every row that takes part; q: floor(scale * x) of every component, see narrowest().

    Rows whose vector is null or holds a null or non-finite component, and such whose scaled component is beyond a double, take no part.
    """
    rows = numbered(settled(table)).select(ROW, F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[c.alias(n) for n, c in more.items()])

    names = list(more)

    def batch(b):
        column = b.column(2)
        at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(scale * (column.values.to_numpy(zero_copy_only=False).astype(np.float64))) + 0.0  # null components become NaN; no negative zero
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(q))))
        keep = np.flatnonzero(there & (bad[at[1:]] == bad[at[:-1]]))
        size = np.array([norms(q[None, at[k] : at[k + 1]])[0] for k in keep])
        cut = b.take(pa.array(keep, pa.int64()))
        made = {ROW: cut.column(0), "id": cut.column(1), "dim": at[keep + 1] - at[keep], "norm": size, "q": [narrowest(q[at[k] : at[k + 1]])[1] for k in keep]}
        return made | {n: cut.column(3 + k) for k, n in enumerate(names)}

    schema = f"{ROW} {ROW_TYPE}, id long, dim int, norm double, q binary" + "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in more)
    return arrow_map(rows, batch, schema)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the right singular vectors (columns, the largest first, at most AXES) of some unit vectors."""
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(8.0 * F.col("dim")).alias("bytes")).first()
    share = min(1.0, SAMPLE / max(seen.n, 1), SAMPLE_BYTES / max(seen.bytes or 0, 1))
    spot = F.pmod(F.xxhash64("q", "id"), F.lit(1 << 30)) < int(share * (1 << 30))
    by_dim: dict[int, list[bytes]] = {}
    for r in vectors.filter(spot).select("dim", "q").limit(2 * SAMPLE).collect():
        by_dim.setdefault(r.dim, []).append(bytes(r.q))
    out = {}
    for dim, blobs in by_dim.items():
        if dim and len(blobs) >= AXES:
            q = matrix_of(blobs, dim)
            out[dim] = np.linalg.svd(q / np.maximum(norms(q), 1)[:, None], full_matrices=False)[2][:AXES].T.copy()
    return out


def axes_for(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return axes[dim] if dim in axes else np.eye(dim, min(dim, AXES))


def least_ids(vectors: DataFrame, keep: int, *keys: str) -> DataFrame:
    """Of equal vectors (under equal keys) the rows of the `keep` least ids: no later one is ever among the first `keep` rows, since equal scores go by id.

    Spark limits each key before the shuffle too, so a vector that a third of all rows share is no hot key.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("dim", "q", *keys).orderBy(F.col("id").asc_nulls_last(), ROW)
    return vectors.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep).drop("_n")


def first_of_each(key: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first `keep` rows of every key, by descending score, then id."""
    order = np.lexsort((ids, -score, key))
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < keep]


class Best:
    """The first `keep` rows of each of n keys so far, and the score that a further row must reach (`floor`)."""

    def __init__(self, floor: np.ndarray, keep: int):
        self.floor, self.keep = floor.copy(), keep
        self.key, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ids, ids)))
        at = first_of_each(key, score, ids, self.keep)
        self.key, self.score, self.ids = key[at], score[at], ids[at]
        full = np.flatnonzero(np.bincount(self.key, minlength=len(self.floor)) == self.keep)
        last = np.searchsorted(self.key, full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])
