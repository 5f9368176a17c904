"""SimHash near-dedup: fingerprints of word shingles, linked through generalised pigeonhole partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, apart, arrow_map, discard_since, numbered, settled, slices, stage, staged_now, whole_rows
from .components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Larger buckets aren't compared pair by pair but joined through neighbour keys.
MAX_BUCKET = 32

_LANES = np.uint64(0x0101010101010101)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set. Eight bits at a time are summed in the byte lanes of a word."""
    sums = np.zeros((8, 8), np.int64)
    for start in range(0, len(hashes), 255):
        part = hashes[start : start + 255]
        for shift in range(8):
            lanes = np.array([((part >> np.uint64(shift)) & _LANES).sum(dtype=np.uint64)])
            sums[:, shift] += lanes.astype("<u8").view(np.uint8)
    return sums.reshape(64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        grams = [b" ".join(words)]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -SHINGLE_WORDS])).tolist()
        grams = [joined[a:b] for a, b in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    bits = _bit_sums(hashes) * 2 > len(hashes)
    return int(np.packbits(bits[::-1]).view(">u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """__row, id and fingerprint of every document."""
    rows = numbered(settled(docs)).select(ROW, F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))

    def batch(b):
        return {ROW: b.column(0), "id": b.column(1), "fp": [fingerprint(t) for s in slices([b]) for t in s.column(2).to_pylist()]}

    return arrow_map(rows, batch, f"{ROW} {ROW_TYPE}, id {rows.schema['id'].dataType.simpleString()}, fp long")


def _bit_pairs(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which both bits are set, over all fingerprints."""

    def batch(b):
        bits = np.unpackbits(b.column(0).to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both = (bits.T @ bits).astype(np.int64)
        i, j = np.indices(both.shape)
        return {"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "n": both.ravel()}

    out = np.zeros((64, 64))
    for i, j, n in arrow_map(fps.select("fp"), batch, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return out


def _group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each group gathers the bits most correlated with those in it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [left.pop(int(np.argmax(strength[np.ix_(left, left)].sum(1))))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(strength[np.ix_(left, group)].sum(1)))))
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The signed 64-bit mask of some bits."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).astype(np.int64)[0])


def _allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds -1.. per partition that sum to budget at the least cost. costs[i][t + 1] is that of threshold t."""
    best = {0: (0.0, [])}
    for row in costs:
        after = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                found = (cost + row[t + 1], [*chosen, t])
                if used + t not in after or found < after[used + t]:
                    after[used + t] = found
        best = after
    return best.get(budget, (float("inf"), []))


def plan(fps: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed.

    By the general pigeonhole principle two fingerprints within radius differ in at most t_i bits of some
    partition i if the thresholds add up to radius - parts + 1; a threshold of -1 leaves a partition out.
    The candidates of threshold 0 are counted on all fingerprints, those of larger ones scaled up by the
    odds that a bit differs; a dynamic program picks the thresholds for each number of partitions.
    """
    both = _bit_pairs(fps)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p) + 1e-6
    options = {m: _group_bits(both, n, m) for m in range(2, radius + 2)}
    wanted = [(m, k, mask_of(bits)) for m, groups in options.items() for k, bits in enumerate(groups)]
    spread = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, k, mask in wanted]))
    sizes = fps.select(spread.alias("x")).select("x.*").groupBy("m", "k", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    equal = {(r.m, r.k): r.pairs for r in sizes.groupBy("m", "k").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    best = (float("inf"), [], [])
    for m, groups in options.items():
        costs = []
        for k, bits in enumerate(groups):
            odds, pairs, probes, row = float((differ[bits] / (1 - differ[bits])).sum()), equal.get((m, k), 0.0), 1.0, [0.0]
            for t in range(radius + 1):
                row.append(n * probes + pairs * sum(odds**s for s in range(t + 1)))
                probes += len(bits) ** (t + 1)
            costs.append(row)
        cost, chosen = _allocate(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, chosen, groups)
    return [(bits, t) for bits, t in zip(best[2], best[1]) if t >= 0]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of at most `most` set bits among bits."""
    from itertools import combinations

    return [mask_of(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges u, v that connect distinct fingerprints just as all pairs within radius would. fps: fp long, distinct.

    Probes of small buckets give candidates that are verified one by one. Fingerprints of buckets with
    more than max_bucket members are all joined through the keys at distance up to one of each of them:
    two that share such a key differ in two bits at most, and any two within two bits share one, so
    nothing is lost and the rows grow with the members, not with their pairs.
    """
    if radius != 2:
        raise ValueError("crowded buckets are joined for radius 2")
    n = fps.count()
    chosen = plan(fps, n, radius)
    keyed = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("v")) for k, (bits, _) in enumerate(chosen)]
    probed = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).bitwiseXOR(F.lit(flip)).alias("v")) for k, (bits, t) in enumerate(chosen) for flip in _flips(bits, t)]
    index = fps.select("fp", F.explode(F.array(*keyed)).alias("x")).select("fp", "x.k", "x.v")
    probes = fps.select("fp", F.explode(F.array(*probed)).alias("x")).select(F.col("fp").alias("probe"), "x.k", "x.v")
    sizes = index.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    asked = probes.groupBy("k", "v").agg(F.count(F.lit(1)).alias("asked"))
    sizes = stage(sizes.join(asked, ["k", "v"]).filter("c > 1 or asked > c"), "buckets")
    small = sizes.filter((F.col("c") <= max_bucket) & (F.col("asked") <= max_bucket)).select("k", "v")
    large = sizes.filter((F.col("c") > max_bucket) | (F.col("asked") > max_bucket)).select("k", "v")
    near = probes.join(small, ["k", "v"]).join(index, ["k", "v"])
    near = near.filter("probe <> fp").filter(F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= radius)
    crowded = index.join(large, ["k", "v"]).select("fp").union(probes.join(large, ["k", "v"]).select(F.col("probe").alias("fp"))).distinct()
    around = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(flip)) for flip in _flips(list(range(64)), 1)])).alias("key"))
    hubs = around.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 65 each
    star = hubs.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return near.select(F.greatest("probe", "fp").alias("u"), F.least("probe", "fp").alias("v")).union(star).distinct()


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """__row, id, fp and component_id of every document; component_id is the smallest id its links reach.

    A null or blank text has fingerprint 0 and links like any other. A null id is never a component_id
    unless a component has no other. keep_row is the row of the one that stays: the least id, then place.
    Rows that repeat an id are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    rows = stage(fingerprints(docs, text, id_col), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(ROW).alias("row"))
    classes = stage(rows.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    before = staged_now()
    found = components(links(classes.select("fp")))
    discard_since(before, found)
    roots = classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = roots.groupBy("root").agg(F.min("first").alias("best"))
    roots = roots.join(apart(least, "root"), "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row"))
    return rows.join(roots, "fp")


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, one of each group that near_groups() finds; all columns stay, whatever their names."""
    docs = settled(docs)
    found = near_groups(docs, text, id_col)
    losers = found.filter(F.col("keep_row") != F.col(ROW)).select(ROW)
    return whole_rows(docs).join(losers, ROW, "left_anti").select("doc.*")
