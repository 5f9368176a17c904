"""Line dedup by winnowing: minima of windows of line hashes are selected, equal ones joined, matches extended both ways, later runs deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, apart, discard, numbered, settled, stage, whole_rows

#: Shorter runs are left alone unless they have many words and that is asked for; also the window of which a minimum is selected.
MIN_RUN = 3
#: Lines of a block in which matches are extended. Blocks overlap by a window, so none is cut in two.
BLOCK = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: str) -> Column:
    return F.transform(lines_of(F.col(text)), lambda x: F.xxhash64(x))


def _least_at(part: Column) -> Column:
    """Place of the leftmost least hash in a stretch, from 0."""
    return F.array_position(part, F.array_min(part)).cast("int") - 1


def _lengths(run: int, min_words: int | None) -> range:
    """Numbers of lines of the stretches that count."""
    return range(1 if min_words else run, run + 1)


def fingerprints(docs: DataFrame, text: str, id_col: str, run: int, min_words: int | None = None) -> DataFrame:
    """One row per selected line: len, place, finger (its hash), and the hashes around it that a window with it can hold, the first at `lo`.

    Every window of `run` lines, and every shorter one with min_words words or more if that is given, selects its
    leftmost least hash; a line that several windows of one length select is one row. words: numbers of words of the lines around.
    """
    count = F.transform(lines_of(F.col(text)), lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))) if min_words else F.lit(None).cast("array<int>")
    rows = docs.select(ROW, F.col(id_col).alias("id"), _hashes(text).alias("h"), count.alias("words"))

    def selected(n: int) -> Column:
        starts = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        if n < run:
            starts = F.filter(starts, lambda i: F.aggregate(F.slice("words", i + 1, F.lit(n)), F.lit(0), lambda s, x: s + x) >= min_words)
        places = starts if n == 1 else F.array_distinct(F.transform(starts, lambda i: i + _least_at(F.slice("h", i + 1, F.lit(n)))))
        lo = lambda p: F.greatest(p - (n - 1), F.lit(0))
        around = lambda c, p: F.slice(c, lo(p) + 1, p + n - lo(p))
        words = lambda p: around("words", p) if n < run else F.lit(None).cast("array<int>")
        return F.transform(places, lambda p: F.struct(F.lit(n).alias("len"), p.alias("place"), F.get("h", p).alias("finger"), lo(p).alias("lo"), around("h", p).alias("around"), words(p).alias("words")))

    found = rows.select(ROW, "id", F.explode(F.concat(*[selected(n) for n in _lengths(run, min_words)])).alias("x"))
    return found.select(ROW, "id", "x.*")


def seeds(found: DataFrame, run: int, min_words: int | None = None) -> DataFrame:
    """For every line and length: place, the windows that selected it (start and hash each, the least match that counts), and the hash and start of all of them together."""
    n = F.col("len")
    part = lambda c, s: F.slice(c, s - F.col("lo") + 1, n)
    last = F.least(F.col("place"), F.col("lo") + F.size("around") - n)
    starts = F.when(last >= F.col("lo"), F.sequence(F.col("lo"), last)).otherwise(F.array().cast("array<int>"))
    mine = lambda s: s + _least_at(part("around", s)) == F.col("place")
    long = lambda s: (n == run) | (F.aggregate(part("words", s), F.lit(0), lambda t, x: t + x) >= min_words) if min_words else F.lit(True)
    each = F.transform(F.filter(starts, lambda s: mine(s) & long(s)), lambda s: F.struct(s.alias("start"), F.xxhash64(part("around", s)).alias("window")))
    found = found.withColumn("windows", each).filter(F.size("windows") > 0)
    first = F.col("windows")[0]["start"]
    context = F.slice("around", first - F.col("lo") + 1, F.element_at("windows", -1)["start"] - first + n)
    return found.select(ROW, "id", "finger", "len", first.alias("start"), F.xxhash64(context).alias("window"), "windows")


def _matched(keys: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are a later place of their window, with the first place r0, s0; the other rows). keys: rows without what only the second needs."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(ROW).alias("row"), F.col("start").alias("start"))
    key = ["finger", "window", "len"]
    first = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1").select(*key, F.col("first.row").alias("r0"), F.col("first.start").alias("s0"))
    is_later = F.col("r0").isNotNull() & ((F.col(ROW) != F.col("r0")) | (F.col("start") != F.col("s0")))
    both = rows.join(apart(first, *key), key, "left")
    return both.filter(is_later), both.filter(~is_later).select(*rows.columns)


def _blocks(docs: DataFrame, text: str, run: int) -> DataFrame:
    """Lines of every document in blocks, each line as two hashes: block, first line, lines."""
    lines = F.transform(lines_of(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(run), x).alias("b")))
    rows = docs.select(ROW, lines.alias("v"))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / BLOCK).cast("int")), lambda k: F.struct(k.alias("block"), F.slice("v", k * BLOCK + 1, F.lit(BLOCK + run - 1)).alias("lines")))
    return rows.select(ROW, F.explode(each).alias("x")).select(ROW, "x.block", "x.lines")


def _seeds(matches: DataFrame) -> DataFrame:
    """__row, r0, shift, block, block0 and the seeds (start, len) of a diagonal in a pair of blocks. Of matches that touch one is enough: extension finds what the others cover."""
    pairs = matches.select(ROW, "start", "len", "r0", (F.col("start") - F.col("s0")).alias("shift"), F.floor(F.col("start") / BLOCK).cast("int").alias("block"), F.floor(F.col("s0") / BLOCK).cast("int").alias("block0"))
    pairs = pairs.groupBy(ROW, "r0", "shift", "block", "block0").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("seeds"))
    alone = lambda x, i: (i == 0) | (x["start"] > F.get("seeds", i - 1)["start"] + F.get("seeds", i - 1)["len"])
    return pairs.withColumn("seeds", F.filter("seeds", alone))


def _extended(matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """__row, from, len of the runs of equal lines around matches. matches: __row, start, len, and the earlier place r0, s0.

    Matches of one diagonal in a pair of blocks are extended together. The lines are compared again by both hashes;
    a match that does not hold is dropped. What goes beyond a block is found from the matches in the next one.
    """
    pairs = _seeds(matches)
    there = blocks.select(F.col(ROW).alias("r0"), F.col("block").alias("block0"), F.col("lines").alias("lines0"))
    both = pairs.join(blocks, [ROW, "block"]).join(there, ["r0", "block0"])
    at, at0 = F.col("block") * BLOCK, F.col("block0") * BLOCK + F.col("shift")
    low = F.greatest(at, at0)
    n = F.least(at + F.size("lines"), at0 + F.size("lines0")) - low
    both = both.select(ROW, "seeds", low.alias("low"), n.alias("n"), F.zip_with(F.slice("lines", low - at + 1, n), F.slice("lines0", low - at0 + 1, n), lambda x, y: x == y).alias("same"))
    both = both.select(ROW, "seeds", "low", "n", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: ~F.get("same", i)).alias("off"))

    def run(s: Column) -> Column:
        j = s["start"] - F.col("low")
        before = F.coalesce(F.array_max(F.filter("off", lambda i: i < j)), F.lit(-1))
        after = F.coalesce(F.array_min(F.filter("off", lambda i: i >= j)), F.col("n"))
        return F.struct((F.col("low") + before + 1).alias("from"), (after - before - 1).alias("len"), (after - j >= s["len"]).alias("holds"))

    runs = F.array_distinct(F.filter(F.transform("seeds", run), lambda r: r["holds"]))
    return both.select(ROW, F.explode(runs).alias("x")).select(ROW, "x.from", "x.len")


def repeated_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """__row and runs (first line, number of lines) of every document that has lines to delete.

    A stretch of `run` lines, or of fewer with min_words words or more if that is given, goes if it occurred before: in a row of
    smaller id (null last), or of an earlier place, or earlier in the same text. Two equal stretches select
    the same line, so only lines whose hash is selected twice are looked at. Such a line is joined to the first place where all
    windows that selected it are the same; where there is none, each window to the first place of its own. One seed of each stretch is
    extended to the lines before and after it. Counts are partial sums and joins can be split: a line may stand in most documents.
    """
    docs = settled(docs)
    rows = numbered(docs)
    kept = stage(fingerprints(rows, text, id_col, run, min_words), "fingerprints")
    shared = kept.groupBy("len", "finger").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len", "finger")
    found = stage(seeds(kept.join(apart(shared, "len", "finger"), ["len", "finger"], "left_semi"), run, min_words), "seeds")
    discard(kept)
    later, rest = _matched(found.drop("windows"), found)
    # its first and its last window, as these may begin in two blocks
    ends = F.array_distinct(F.array(F.col("start"), F.element_at("windows", -1)["start"]))
    match = [ROW, "start", "len", "r0", "s0"]
    later = later.select(ROW, "start", "len", "r0", "s0", F.explode(ends).alias("at"))
    later = later.select(ROW, F.col("at").alias("start"), "len", "r0", (F.col("at") - F.col("start") + F.col("s0")).alias("s0"))
    # a window whose first place has been matched as a whole has an earlier one, so the others know all first places
    rest = stage(rest, "rest")
    single = rest.select(ROW, "id", "finger", "len", F.explode("windows").alias("x")).select(ROW, "id", "finger", "len", "x.*")
    later = later.unionByName(_matched(single, single)[0].select(*match))
    blocks = stage(_blocks(rows, text, run), "line-blocks")
    spans = stage(_extended(later, blocks), "runs")
    discard(found, rest, blocks)
    by_row = Window.partitionBy(ROW).orderBy("from", "len")
    end = F.max(F.col("from") + F.col("len")).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("from") > end).cast("int")
    islands = spans.withColumn("island", F.sum(F.coalesce(fresh, F.lit(0))).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(ROW, "island").agg(F.min("from").alias("from"), (F.max(F.col("from") + F.col("len")) - F.min("from")).alias("len"))
    return runs.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("from", "len"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """All columns of docs, the text without repeated runs; also n_lines and n_removed (columns of these names are replaced).

    A null text stays null and counts one empty line. Rows that repeat an id are documents of their own. An empty table gives no rows.
    """
    docs = settled(docs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # runs grow with the documents, so they are never broadcast, not even where a small table would allow it
    rows = whole_rows(docs).join(repeated_runs(docs, text, id_col, run, min_words).hint("merge"), ROW, "left")
    old = F.col("doc").getField(text)
    lines, runs = lines_of(old), F.coalesce(F.col("runs"), F.array().cast("array<struct<from:int,len:int>>"))
    before = F.transform(runs, lambda r, i: F.when(i == 0, r["from"]).otherwise(r["from"] - F.get(runs, i - 1)["from"] - F.get(runs, i - 1)["len"]))
    kept = F.flatten(F.transform(runs, lambda r, i: F.slice(lines, r["from"] - F.get(before, i) + 1, F.get(before, i))))
    last = F.element_at(runs, -1)
    tail = F.slice(lines, last["from"] + last["len"] + 1, F.size(lines))
    cut = F.when((F.size(runs) == 0) | old.isNull(), old).otherwise(F.array_join(F.concat(kept, tail), "\n"))
    removed = F.aggregate(runs, F.lit(0), lambda s, r: s + r["len"])
    return rows.select(*[(cut if c == text else F.col("doc").getField(c)).alias(c) for c in names], F.size(lines).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
