"""Exact top-k search: vectors by descending length, partial products along singular vectors, Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, discard, discard_since, in_tasks, stage, staged_now
from .integer_vectors import NO_ID, Best, axes_for, integer_vectors, least_ids, matrix, matrix_of, narrowest, norms, principal_axes, products

SCALE, TOP = 1024, 10
#: Bytes of the vectors of a strip of candidates and of a group of queries (as int16), and rows of each that are multiplied at a time.
STRIP, GROUP, QUERY_BLOCK, BLOCK = 2 << 20, 4 << 20, 512, 2048
#: Shares of the axes after each of which the pairs that can't reach a query's k-th score are given up.
SHARES = (0.125, 0.25, 0.5, 1.0)
#: No score is below this, so it lets everything in.
LEAST = np.iinfo(np.int64).min


def below(floor: np.ndarray) -> np.ndarray:
    """What a bound in doubles must be under before it surely misses a whole number."""
    return floor - 0.5 - np.abs(floor.astype(np.float64)) * 1e-12


def search(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, axes: np.ndarray, top: int, seen: list | None = None) -> Best:
    """The first `top` candidates of each query among c, which come by descending length, as far as they reach the query's floor.

    A query is done at the first block whose longest vector, times its own length, misses its k-th score. In the others products
    are accumulated along the axes; the rest of a pair is at most the product of the lengths of what is left of both.
    What may reach the k-th score is computed in integers. seen: gets queries and candidates of each block multiplied, and the share of axes.
    """
    best = Best(floor, top)
    lq, lc = norms(q), norms(c)
    uq, uc = q / np.where(lq > 0, lq, 1)[:, None], c / np.where(lc > 0, lc, 1)[:, None]
    rq, rc = uq @ axes, uc @ axes
    ends = sorted({max(1, round(axes.shape[1] * share)) for share in SHARES}) if axes.shape[1] else []
    left_q, left_c = ([np.sqrt(np.maximum((u * u).sum(1) - (r[:, :e] ** 2).sum(1), 0)).astype(np.float32) for e in ends] for u, r in ((uq, rq), (uc, rc)))
    rq, rc = rq.astype(np.float32), rc.astype(np.float32)
    slack = 1e-6 * (8 + axes.shape[1])  # single precision, unit vectors; the square root above is off by some 1e-8
    for start in range(0, len(q), QUERY_BLOCK):
        for at in range(0, len(c), BLOCK):
            rows = start + np.flatnonzero(~(lq[start : start + QUERY_BLOCK] * lc[at] * (1 + 1e-9) < below(best.floor[start : start + QUERY_BLOCK])))
            if not len(rows):
                break
            cols = np.arange(at, min(at + BLOCK, len(c)))
            total, k = np.zeros((len(rows), len(cols)), np.float32), 0
            i, j = np.divmod(np.arange(total.size), len(cols)) if not ends else (None, None)
            for k, (begin, end) in enumerate(zip([0, *ends[:-1]], ends)):
                total += rq[rows, begin:end] @ rc[cols, begin:end].T
                reach = (total + np.multiply.outer(left_q[k][rows], left_c[k][cols]) + slack).astype(np.float64)
                open_ = ~(reach * lq[rows, None] * lc[None, cols] < below(best.floor[rows])[:, None])
                i, j = np.nonzero(open_)
                if len(i) * 64 <= open_.size:
                    break
                wide, tall = open_.any(1), open_.any(0)
                if wide.mean() * tall.mean() < 0.5:
                    total, rows, cols = total[np.ix_(wide, tall)], rows[wide], cols[tall]
                    i, j = (np.cumsum(wide) - 1)[i], (np.cumsum(tall) - 1)[j]
            if seen is not None:
                seen.append((len(rows), len(cols), ends[k] / axes.shape[1] if ends else 0))
            if not len(i):
                continue
            if len(i) * 16 > len(rows) * len(cols):
                score = products(q[rows], c[cols])[i, j]
            elif np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
                score = np.concatenate([np.einsum("nd,nd->n", q[rows[i[x : x + 65536]]], c[cols[j[x : x + 65536]]]) for x in range(0, len(i), 65536)]).astype(np.int64)
            else:
                score = np.array([products(q[[rows[x]]], c[[cols[y]]])[0, 0] for x, y in zip(i, j)])
            i, j = rows[i], cols[j]
            good = (score >= best.floor[i]) & (q_rows[i] != c_rows[j]).any(1)
            best.add(i[good], score[good], c_ids[j[good]])
    return best


def _ids(column) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8")


def _places(column) -> np.ndarray:
    return np.stack([column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1).astype("<i8")


STRIP_SCHEMA = "strip long, dim long, top double, rows long, width long, ids binary, places binary, vectors binary"


def strips_of(vectors: DataFrame, strip: int) -> DataFrame:
    """One row for each strip of candidates of one dimension, in descending order of length within and over the strips (ties of length are dealt by hash)."""
    seen = vectors.agg(F.sum(2.0 * F.col("dim")).alias("bytes")).first()
    parts = max(1, min(4096, int((seen.bytes or 0) / strip) + 1))
    placed = vectors.withColumn("_tie", F.xxhash64(ROW))
    order = [F.col("dim"), F.col("norm").desc(), F.col("_tie")]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(ROW, "id", "dim", "norm", "q")

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []

        def close():
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dim = table.column(2)[0].as_py()
            q = matrix_of(table.column(4).to_pylist(), dim)
            width, blob = narrowest(q)
            row = [number, dim, table.column(3)[0].as_py(), table.num_rows, width, _ids(table.column(1)).tobytes(), _places(table.column(0)).tobytes(), blob]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in STRIP_SCHEMA.split(", ")]
        for b in batches:
            while b.num_rows:
                dims = b.column(2).to_numpy()
                if held and held[0].column(2)[0].as_py() != dims[0]:
                    yield close()
                most = max(64, strip // (2 * max(1, int(dims[0]))))
                take = min(int(np.searchsorted(dims, dims[0], "right")), most - sum(x.num_rows for x in held))
                held.append(b.slice(0, take))
                b = b.slice(take)
                if sum(x.num_rows for x in held) == most:
                    yield close()
        if held:
            yield close()

    return in_tasks(placed, run, STRIP_SCHEMA)


def _groups(queries: DataFrame) -> DataFrame:
    """One row for each group of queries: g, dim, reach (vectors shorter than this are of no use to it), rows and the queries as bytes. queries: with floor and g."""

    def blob(table: pa.Table) -> pa.Table:
        dim, rows = table.column("dim")[0].as_py(), table.num_rows
        q, floor = matrix_of(table.column("q").to_pylist(), dim), table.column("floor").to_numpy()
        size = norms(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(floor == LEAST, -np.inf, np.where(size > 0, below(floor) / size, np.where(floor > 0, np.inf, -np.inf))).min()
        width, vectors = narrowest(q)
        rows_of = table.column(ROW).combine_chunks()
        made = [table.column("g")[0].as_py(), dim, float(reach), rows, width, _ids(table.column("id").combine_chunks()).tobytes(), _places(rows_of).tobytes(), floor.astype("<i8").tobytes(), vectors]
        return pa.table({n: [x] for n, x in zip(("g", "dim", "reach", "g_rows", "g_width", "g_ids", "g_places", "floors", "g_vectors"), made)})

    return queries.groupBy("g").applyInArrow(blob, "g long, dim long, reach double, g_rows long, g_width long, g_ids binary, g_places binary, floors binary, g_vectors binary")


def _visit(pairs: DataFrame, groups: DataFrame, strips: DataFrame, axes: dict, top: int) -> DataFrame:
    """place, query_id, vec_id, score: the first candidates of each query in each strip of pairs (g, strip)."""
    read = pairs.join(strips.drop("dim", "top"), "strip").join(groups.drop("reach").withColumnRenamed("dim", "g_dim"), "g")

    def one(r: dict) -> pa.RecordBatch:
        dim = r["g_dim"]
        q, c = matrix(r["g_vectors"], r["g_width"], r["g_rows"], dim), matrix(r["vectors"], r["width"], r["rows"], dim)
        q_rows, c_rows = (np.frombuffer(r[n], "<i8").reshape(-1, 2) for n in ("g_places", "places"))
        best = search(q, q_rows, np.frombuffer(r["floors"], "<i8"), c, c_rows, np.frombuffer(r["ids"], "<i8"), axes_for(axes, dim), top)
        place = pa.StructArray.from_arrays([pa.array(q_rows[best.key, k]) for k in (0, 1)], ["file", "index"])
        ids = pa.array(best.ids, mask=best.ids == NO_ID)
        return pa.RecordBatch.from_arrays([place, pa.array(np.frombuffer(r["g_ids"], "<i8")[best.key]), ids, pa.array(best.score)], [ROW, "query_id", "vec_id", "score"])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield one(b.slice(k, 1).to_pylist()[0])

    return in_tasks(read, run, f"{ROW} struct<file:bigint,index:bigint>, query_id long, vec_id long, score long")


def _first(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy(ROW).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_products(table: DataFrame, queries: Column, vector: str = "embedding", id_col: str = "vec_id", scale: int = SCALE, top: int = TOP, strip: int = STRIP, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of greatest inner product with each row for which `queries` (a condition on id) holds.

    Components become floor(scale * x) and scores are exact. Candidates are all rows of the same vector length but the query's own row; fewer than
    `top` give fewer ranks. Equal scores go by id, null ids last. Rows whose vector is null or holds a null or non-finite component take no part; an
    empty or zero vector scores zero. Repeated ids are rows of their own; other columns are ignored; an empty table gives no rows. Ids are longs below 2^63 - 1.

    Candidates are kept in strips by descending length. Every group of queries reads the first strip of its dimension, which gives each query a k-th score, and
    then those strips whose longest vector could still reach one. Queries and candidates meet in blocks: no pair of rows is ever a row of a table.
    """
    before = staged_now()
    vectors = stage(integer_vectors(table, scale, vector, id_col), "vectors")
    axes = principal_axes(vectors)
    strips = stage(strips_of(least_ids(vectors, top + 1), strip), "strips")
    asked = vectors.filter(queries)
    seen = asked.agg(F.sum(2.0 * F.col("dim")).alias("bytes")).first()
    buckets = int((seen.bytes or 0) / group) + 1
    asked = asked.withColumn("g", F.col("dim").cast("long") * (1 << 32) + F.pmod(F.xxhash64(ROW), F.lit(buckets)))
    reach = strips.select("strip", "dim", "top")
    head = reach.groupBy("dim").agg(F.min("strip").alias("strip"))
    groups = stage(_groups(asked.withColumn("floor", F.lit(int(LEAST)).cast("long"))), "queries")
    first = stage(_visit(groups.select("g", "dim").join(head, "dim").select("g", "strip"), groups, strips, axes, top), "first")
    known = _first(first, top).filter(F.col("rank") == top).select(ROW, F.col("score").alias("floor"))
    discard(groups)
    asked = asked.join(known, ROW, "left").withColumn("floor", F.coalesce("floor", F.lit(int(LEAST)).cast("long")))
    groups = stage(_groups(asked), "queries")
    rest = reach.join(head.select(F.col("strip")), "strip", "left_anti")
    pairs = groups.select("g", "dim", "reach").join(rest, "dim").filter(F.col("top") * (1 + 1e-9) >= F.col("reach")).select("g", "strip")
    found = stage(first.unionByName(_visit(pairs, groups, strips, axes, top)), "found")
    discard_since(before, found)
    return _first(found, top).select("query_id", "rank", "vec_id", "score")
