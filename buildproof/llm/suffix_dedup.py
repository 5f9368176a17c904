"""Suffix-array dedup: remove every byte covered by a string of DEPTH bytes that starts anywhere else as well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, apart, discard, in_tasks, numbered, settled, slices, stage, whole_rows
from .suffix_array import range_hashes, repeated_starts

DEPTH = 200
#: Bytes of the strings whose hashes pick a window's anchor.
GRAM = 32
#: Bytes of text that are looked at together in a task.
BLOCK = 1 << 19
#: Anchors in more different contexts than this are told apart further: first by sections of so many
#: windows, each with the hash of the bytes that all these windows share, then by single windows.
CROWD, SECTION = 1000, 16

_LOW = np.uint64(BLOCK * 2 - 1)


def anchors(texts: list[bytes], depth: int = DEPTH):
    """(text, first start, last start, place, gram hash) of every anchor of every text.

    The anchor of a window of `depth` bytes is the gram with the least hash in it, the leftmost of equals. It depends on
    the window's bytes alone, so equal windows have equal anchors, at the same place in them. Windows that
    follow each other mostly share an anchor; the starts first..last are all that have this one.
    """
    units, size = [], 0
    for k, t in enumerate(texts):
        for base in range(0, max(len(t) - depth + 1, 0), BLOCK // 2):
            piece = t[base : base + BLOCK // 2 + depth - 1]
            if size + len(piece) > BLOCK and units:
                yield from _anchors(units, depth)
                units, size = [], 0
            units.append((k, base, piece))
            size += len(piece)
    if units:
        yield from _anchors(units, depth)


def _anchors(units, depth):
    sizes = np.array([len(p) for _, _, p in units])
    data = np.frombuffer(b"".join(p for _, _, p in units), np.uint8).astype(np.int16)
    n = len(data)
    at = np.arange(n - GRAM + 1)
    gram = range_hashes(data, at, at + GRAM)
    least = (gram & ~_LOW) | at.astype(np.uint64)
    width, have = depth - GRAM + 1, 1
    while have < width:  # minima of ever wider windows
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = np.repeat(np.arange(len(units)), sizes)
    start = np.cumsum(sizes) - sizes
    fits = np.arange(n) + depth <= np.repeat(start + sizes, sizes)
    starts = np.flatnonzero(fits)
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, h = starts[first], starts[last], gram[anchor[first]].astype(np.int64)
    unit = owner[lo]
    text, base = np.array([u[0] for u in units])[unit], np.array([u[1] for u in units])[unit] - start[unit]
    yield text, lo + base, hi + base, anchor[first] + base, h


def _anchor_rows(docs: DataFrame, depth: int) -> DataFrame:
    """h: anchor's hash; x: hash of its context, the bytes of all its windows; q: first start << 16 | distance of the anchor from it << 8 | further starts."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, 1024):
            texts = b.column(1).to_pylist()
            for text, lo, hi, at, h in anchors(texts, depth):
                x = np.array([digest(texts[k][a:z]) for k, a, z in zip(text.tolist(), lo.tolist(), (hi + depth).tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x.astype(np.int64)), b.column(0).take(pa.array(text)), pa.array((lo << 16) | ((at - lo) << 8) | (hi - lo))], names=["h", "x", ROW, "q"])

    return in_tasks(docs, run, f"h long, x long, {ROW} {ROW_TYPE}, q long")


def _packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, since they are shuffled whole."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t) for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=[ROW, "z", "id"])

    return in_tasks(docs, run, f"{ROW} {ROW_TYPE}, z binary, id {docs.schema['id'].dataType.simpleString()}")


def _runs(starts: np.ndarray) -> list[int]:
    """Sorted starts as first, number, first, number, ..."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.concatenate(([0], cut))]
    return np.column_stack((first, np.diff(np.concatenate(([0], cut, [len(starts)]))))).ravel().tolist()


def _contexts(firsts: DataFrame, packed: DataFrame, depth: int) -> DataFrame:
    """The bytes of each context that an anchor occurs in, read at one place of it; of crowded anchors, the bytes of each section.

    i: the first window of a section, null for a whole context. g: hash of anchor, section and the bytes that its
    windows share; y: hash of all its bytes. Sections lie at fixed distances from the anchor, so equal windows are in sections of one g.
    """
    types = {"h": pa.int64(), "x": pa.int64(), "n": pa.int64(), "bytes": pa.binary(), "i": pa.int32(), "g": pa.int64(), "y": pa.int64()}

    def run(batches):
        import xxhash
        import zstandard

        unpack, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def sections(text, h, lo, back, more):
            """(first window, hash of what the windows share, bytes) of each section of a context."""
            at = 0
            while at <= more:  # back - at: how far the anchor is from the window's start
                section = (back - at) // SECTION
                end = min(more, back - section * SECTION)
                wide = lo + back - section * SECTION
                core = text[wide : wide + depth - SECTION + 1]
                yield at, signed(digest(b"%d %d " % (h, section) + core)), text[lo + at : lo + end + depth]
                at = end + 1

        for b in slices(batches):
            at, of = b.column(1).offsets.to_numpy(), b.column(1).values
            h, x, n, q, crowded = (of.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            lo, back, more = q >> 16, (q >> 8) & 0xFF, q & 0xFF
            first, end = lo.tolist(), (lo + more + depth).tolist()
            whole, rows = [], []
            for z, start, stop in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                text = unpack(z)
                whole += [text[first[j] : end[j]] for j in range(start, stop)]
                for j in start + np.flatnonzero(crowded[start:stop]):
                    rows += [(h[j], x[j], n[j], data, i, g, signed(digest(data))) for i, g, data in sections(text, h[j], int(lo[j]), int(back[j]), int(more[j]))]
            used = slice(int(at[0]), int(at[-1]))
            plain = np.flatnonzero(~crowded[used].astype(bool))
            none = pa.nulls(len(plain))
            columns = [pa.array(c[used][plain], pa.int64()) for c in (h, x, n)] + [pa.array([whole[j] for j in plain.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(none.cast(types[c]) for c in ("i", "g", "y"))], names=list(types))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

    per_row = firsts.groupBy(ROW).agg(F.collect_list(F.struct("h", "x", "n", "q", "crowded")).alias("firsts"))
    return in_tasks(packed.join(per_row, ROW).select("z", "firsts"), run, "h long, x long, n long, bytes binary, i int, g long, y long")


def _sorted_repeats(contexts: DataFrame, depth: int) -> DataFrame:
    """h, x and runs of repeated starts, from suffix arrays over the contexts of some anchors at a time.

    All contexts of an anchor meet in one array, so equal windows do.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def made(rows):
            found = repeated_starts([r[3] for r in rows], [r[2] for r in rows], depth)
            hit = [(r[0], r[1], _runs(s)) for r, s in zip(rows, found) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in hit], pa.int64()), pa.array([r[1] for r in hit], pa.int64()), pa.array([r[2] for r in hit], pa.list_(pa.int32()))], names=["h", "x", "runs"])

        for b in batches:
            for row in zip(b.column(0).to_numpy().tolist(), b.column(1).to_numpy().tolist(), b.column(2).to_numpy().tolist(), b.column(3).to_pylist()):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield made(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield made(held)

    return in_tasks(contexts.select("h", "x", "n", "bytes").repartition("h").sortWithinPartitions("h"), run, "h long, x long, runs array<int>")


def _window_repeats(sections: DataFrame, depth: int) -> DataFrame:
    """g, y and runs of repeated starts in sections of which too many share their core: windows are counted one by one."""

    def windows(batches):
        import xxhash

        for b in batches:
            rows = []
            for g, y, n, data in zip(*(c.to_pylist() for c in b.columns)):
                for i in range(len(data) - depth + 1):
                    d = xxhash.xxh3_128_intdigest(data[i : i + depth])
                    rows.append((g, y, n, i, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["g", "y", "n", "i", "w1", "w2"])

    def run(batches):
        for b in batches:
            runs = [_runs(np.unique(np.array(s))) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.int32()))], names=["g", "y", "runs"])

    each = sections.select("g", "y", "n", "bytes").mapInArrow(windows, "g long, y long, n long, i int, w1 long, w2 long")
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    hit = each.join(apart(often, "w1", "w2"), ["w1", "w2"], "left_semi")
    return hit.groupBy("g", "y").agg(F.collect_list("i").alias("starts")).mapInArrow(run, "g long, y long, runs array<int>")


def _crowded_repeats(sections: DataFrame, depth: int, crowd: int) -> DataFrame:
    """h, x and runs of repeated starts of crowded anchors. Equal sections are counted first; few share a core."""
    distinct = sections.groupBy("g", "y").agg(F.sum("n").alias("n"), F.any_value("bytes").alias("bytes"))
    distinct = stage(distinct, "sections")
    many = distinct.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowd).select("g")
    few = distinct.join(apart(many, "g"), "g", "left_anti").select(F.col("g").alias("h"), F.col("y").alias("x"), "n", "bytes")
    found = _sorted_repeats(few, depth).withColumnsRenamed({"h": "g", "x": "y"})
    found = found.union(_window_repeats(distinct.join(apart(many, "g"), "g", "left_semi"), depth))
    shifted = F.transform("runs", lambda v, k: F.when(k % 2 == 0, v + F.col("i")).otherwise(v))
    return sections.select("h", "x", "i", "g", "y").join(found, ["g", "y"]).select("h", "x", shifted.alias("runs"))


def _merge(places, depth: int) -> list[np.ndarray]:
    """Byte ranges (k x 2) covered by windows, for each row of an Arrow list of places: first start of a context, and runs relative to it."""
    at, of = places.offsets.to_numpy(), places.values
    q, runs = of.field(0).to_numpy(zero_copy_only=False), of.field(1)
    ends, flat = runs.offsets.to_numpy(), runs.values.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = np.arange(int(ends[at[0]]), int(ends[at[-1]]), 2)
    place = np.searchsorted(ends, pair, "right") - 1
    row = np.searchsorted(at, place, "right") - 1
    shift = row << 44  # rows one after the other, so that one pass merges all of them
    start = (q[place] >> 16) + flat[pair] + shift
    reach = start + flat[pair + 1] - 1 + depth
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(reach[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else np.zeros(0, np.int64)
    spans = np.column_stack((start[first], reach[np.append(first[1:], len(start)) - 1])) if len(first) else np.zeros((0, 2), np.int64)
    owner = spans[:, 0] >> 44
    cut = np.searchsorted(owner, np.arange(len(places) + 1))
    return [spans[a:z] - (k << 44) for k, (a, z) in enumerate(zip(cut, cut[1:]))]


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", depth: int = DEPTH, crowd: int = CROWD) -> DataFrame:
    """__row, id, n_bytes, n_removed, spans (start, end, ...) and kept (bytes) of every document; null is empty.

    Only windows whose anchor occurs twice can repeat. Where all its contexts are equal, all of each repeats. The others are
    sorted together in suffix arrays, equal ones counted and read once. Neighbours in them that share
    `depth` bytes are repeats, as is all of a context that occurs twice. What is found goes back to every place of its
    context. Matches never cross documents; overlaps and repeats within one document count; rows that
    repeat an id are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    numbers = numbered(settled(docs))
    rows = numbers.select(ROW, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(id_col).alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()
    every = stage(_anchor_rows(rows.filter(F.octet_length("text") >= depth), depth), "anchors")
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("x") == F.max("x")).alias("lone")).filter("n > 1").select("h", "lone")
    found = stage(every.join(apart(shared, "h"), "h"), "shared-anchors")
    discard(every)
    several = found.filter("not lone")
    firsts = several.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(ROW, "q")).alias("at")).select("h", "x", "n", f"at.{ROW}", "at.q")
    firsts = stage(firsts, "contexts")
    crowded = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowd).select("h", F.lit(True).alias("crowded"))
    told = firsts.join(apart(crowded, "h"), "h", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    packed = _packed(rows)
    contexts = stage(_contexts(told, packed, depth), "context-bytes")
    discard(firsts)
    marks = _sorted_repeats(contexts.filter("i is null"), depth).union(_crowded_repeats(contexts.filter("i is not null"), depth, crowd))
    all_of_it = F.array(F.lit(0), (F.col("q").bitwiseAND(F.lit(0xFF)) + 1).cast("int")).alias("runs")
    hits = several.join(marks, ["h", "x"]).select(ROW, "q", "runs").union(found.filter("lone").select(ROW, "q", all_of_it))
    places = hits.groupBy(ROW).agg(F.collect_list(F.struct("q", "runs")).alias("places"))

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            sizes, removed, spans, kept = [], [], [], []
            for z, ranges in zip(b.column(1).to_pylist(), _merge(b.column(2), depth)):
                data = unpack(z)
                flat = ranges.ravel().tolist()
                edge = [0, *flat, len(data)]
                sizes.append(len(data))
                removed.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
                spans.append(flat)
                kept.append(b"".join(data[a:z] for a, z in zip(edge[::2], edge[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=[ROW, "id", "n_bytes", "n_removed", "spans", "kept"])

    joined = packed.join(places, ROW, "left").select(ROW, "z", "places", "id")
    return in_tasks(joined, cut, f"{ROW} {ROW_TYPE}, id {id_type}, n_bytes long, n_removed long, spans array<long>, kept binary")


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All documents and columns, the text without repeated strings (bytes of a character cut in two go) and n_chars, if there, counted anew.

    A text without repeats, null included, stays as it is, with its n_chars; an empty table gives no rows.
    """
    docs = settled(docs)
    found = remove_repeats(docs, text, id_col).filter("n_removed > 0").select(ROW, F.col("kept").alias("__kept"))

    def decode(batches):
        for b in batches:
            texts = [k.decode(errors="ignore") for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[ROW, "__text"])

    changed = found.mapInArrow(decode, f"{ROW} {ROW_TYPE}, __text string")
    joined = whole_rows(docs).join(changed, ROW, "left")
    new = {text: F.coalesce("__text", F.col("doc").getField(text))}
    if "n_chars" in docs.columns and text != "n_chars":
        count = F.col("doc").getField("n_chars")
        new["n_chars"] = F.when(F.col("__text").isNotNull(), F.char_length("__text")).otherwise(count).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
