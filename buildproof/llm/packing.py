"""Best-fit packing of token pieces into sequences: a configuration program over the length histogram."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, in_tasks, numbered, settled, slices, stage

SEQUENCE = 1024
END_ID = 2
#: Phases of the multiplicative weights method and prices asked in each, how fast a length that lags behind gains
#: weight, how much more a long piece is worth than its tokens, and how often what rounding leaves is solved again.
PHASES, ASKED, RATE, POWER, ROUNDS = 2, 24, 0.5, 1.15, 4
#: Of the covering program: turns of pricing at most, and turns without progress; steps of the weights in each and their size; the share of the bound
#: that is near enough; and how often what rounding leaves is packed by the program again.
TURNS, PATIENCE, STEPS, STEP, GAP, AGAIN = 40, 5, 150, 0.4, 0.001, 3
#: Texts that the library encodes itself: those with white space beyond ASCII, with separators that some tables
#: count as white space, with what may be a special token of the file, or with very long words.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ODD_ASCII, LONG_WORD = ("\x1c", "\x1d", "\x1e", "\x1f"), 2000
#: The published pattern of byte-level BPE files of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def needs_care(text: str, special: tuple[str, ...] = ()) -> bool:
    return any(x in text for x in (*_ODD_ASCII, *special)) or (not text.isascii() and bool(_ODD.search(text))) or max(map(len, text.split()), default=0) > LONG_WORD


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 up."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteCodec:
    """Ids of texts by a byte-level BPE file.

    Where the file's ids are the ranks of its merges and it splits text by the published pattern and nothing else, a
    rank-based encoder made of the same file does the bulk; it gives the same ids in less time. Texts that need care,
    and all texts by other files, go to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self._library, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, splitter = config["model"], config.get("pre_tokenizer") or {}
        self.special = tuple(t["content"] for t in config.get("added_tokens") or [])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        known = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True) and not config.get("normalizer") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if known and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)):
            byte = _bytes_of_characters()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        careful = self.fast is None or needs_care(text, self.special)
        return np.array(self._slow(text) if careful else self.fast.encode_ordinary(text), "<u4").tobytes()


def piece_bounds(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `size`, but for a shorter first one."""
    first = n % size or min(n, size)
    return [(0, first), *[(start, size) for start in range(first, n, size)]]


def pieces(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """__row, id, piece, start, length, crc (and ids) of every document's pieces; null is empty.

    The encoder lives as long as a task, so that a reused worker keeps none of it.
    """
    rows = numbered(settled(docs)).select(ROW, F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        codec = ByteCodec(path)
        for b in slices(batches):
            at, cols = [], [[] for _ in range(5)]
            for k, t in enumerate(b.column(2).to_pylist()):
                ids = codec.encode(t) + end
                for j, (start, length) in enumerate(piece_bounds(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(k)
                    for c, v in zip(cols, (j, start, length, zlib.crc32(part), part)):
                        c.append(v)
            at = pa.array(at, pa.int64())
            made = [b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(cols[4], pa.binary())] if keep_ids else [])], names=[ROW, "id", "piece", "start", "length", "crc", *(["ids"] if keep_ids else [])])

    return in_tasks(rows, run, f"{ROW} {ROW_TYPE}, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long" + ", ids binary" * keep_ids)


def best_values(value: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For every room up to size, which length to put into it last for the largest total value, or -1 (knapsack by dynamic programming)."""
    best, taken = np.zeros(size + 1), np.full(size + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        k = upto[room]
        best[room] = best[room - 1]
        if k:
            total = best[room - lengths[:k]] + value[:k]
            j = int(total.argmax())
            if total[j] > best[room] + 1e-12:
                best[room], taken[room] = total[j], j
    return taken


def best_pattern(taken: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The lengths (by index, repeats allowed) that best_values() puts into a room."""
    out = []
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            out.append(int(taken[room]))
            room -= int(lengths[taken[room]])
    return out


def fill(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on a histogram: (lengths of a sequence, number of such sequences)."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps = np.zeros(size + 1, np.int64)  # open sequences by the room they have left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            wide = np.flatnonzero(gaps[length:])
            if not len(wide):
                each = size // length  # new sequences, filled with this length alone
                full, rest = divmod(left, each)
                for pattern, n in (((length,) * each, full), ((length,) * rest, 1)):
                    if n and pattern:
                        open_by_gap[size - sum(pattern)].append((pattern, n))
                        gaps[size - sum(pattern)] += n
                break
            gap = length + int(wide[0])
            pattern, n = open_by_gap[gap].pop()
            used = min(n, left)
            if n > used:
                open_by_gap[gap].append((pattern, n - used))
            open_by_gap[gap - length].append(((*pattern, length), used))
            gaps[gap] -= used
            gaps[gap - length] += used
            left -= used
    return [x for found in open_by_gap.values() for x in found]


def program(counts: dict[int, int], size: int = SEQUENCE) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """(lengths, fractional uses of patterns) of the configuration program: full sequences that use each length as often as it occurs, at most.

    Multiplicative weights: in each phase all lengths are to be used up to the same share of their number. The
    lengths are priced, those that lag behind the most dearly (a price grows exponentially with the lag), those that have
    their share not at all; a knapsack by dynamic programming gives the dearest filling of every room. Each
    lagging length, the longest first, takes the filling of the room that it leaves, as often as the shares allow.
    Then prices are asked again, until nothing more fits.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(k)] for k in lengths], float)
    used, uses = np.zeros(len(lengths)), defaultdict(float)
    for phase in range(1, PHASES + 1):
        goal = need * phase / PHASES
        for _ in range(ASKED):
            lag = np.clip((goal - used) / need * PHASES, 0, 4)
            price = (lengths / size) ** POWER * np.exp(RATE * lag)
            price[used >= goal - 1e-9] = 0
            taken, moved = best_values(price, lengths, size), False
            for i in np.flatnonzero(goal - used > 1e-9)[::-1]:
                pattern = [int(i), *best_pattern(taken, lengths, size - int(lengths[i]))]
                if int(lengths[pattern].sum()) < size:
                    continue
                index, times = np.unique(pattern, return_counts=True)
                amount = float(((goal[index] - used[index]) / times).min())
                if amount > 1e-9:
                    used[index] += amount * times
                    uses[tuple(pattern)] += amount
                    moved = True
            if not moved:
                break
    return lengths, uses


def _rounded(lengths: np.ndarray, uses: dict[tuple[int, ...], float], left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers for fractional uses, as far as pieces are left. What a pattern loses goes to the next with the same longest piece."""
    carried, out = defaultdict(float), []
    for pattern, amount in uses.items():
        carried[pattern[0]] += amount
        whole = int(carried[pattern[0]] + 1e-6)
        carried[pattern[0]] -= whole
        held = [int(k) for k in lengths[list(pattern)]]
        times = {k: held.count(k) for k in held}
        n = min(whole, *(left[k] // m for k, m in times.items()))
        if n:
            out.append((tuple(sorted(held, reverse=True)), n))
            for k, m in times.items():
                left[k] -= n * m
    return out


def _full_first(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram: full ones by program() as often as they can be had, the other pieces best fit, longest first.

    What rounding leaves is a smaller program, solved in turn. If best fit does better with the pieces of the last programs than these did, they are undone.
    Where lengths fill sequences exactly there is little to gain after this; elsewhere it is where cover() starts.
    """
    left = dict(counts)
    whole = [((size,), left.pop(size))] if size in left else []
    rounds: list[list] = []
    for _ in range(ROUNDS):
        left = {k: n for k, n in left.items() if n}
        found = _rounded(*program(left, size), left) if left else []
        if not found:
            break
        rounds.append(found)
    best = None
    for kept in range(len(rounds), min(len(rounds), 1) - 1, -1):
        rest = {k: n for k, n in left.items() if n}
        for held, n in (x for found in rounds[kept:] for x in found):
            for k in held:
                rest[k] = rest.get(k, 0) + n
        made = [*whole, *(x for found in rounds[:kept] for x in found), *fill(rest, size)]
        if best is None or _used(made) < _used(best):
            best = made
    return best


def _used(sequences) -> int:
    return sum(n for _, n in sequences)


def _rising(price: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest prices that don't fall with length: a longer piece is never worth less, as it can stand for a shorter one."""
    runs: list[list[float]] = []
    for p, w in zip(price, weight):
        runs.append([p, w, 1])
        while len(runs) > 1 and runs[-2][0] > runs[-1][0]:
            p2, w2, n2 = runs.pop()
            p1, w1, n1 = runs.pop()
            runs.append([(p1 * w1 + p2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([r[0] for r in runs], [r[2] for r in runs])


def cover(counts: dict[int, int], start: list[tuple[tuple[int, ...], int]], size: int = SEQUENCE) -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray, float, float]:
    """The configuration program itself: fewest fractional uses of patterns of any fill that hold every length as often as it occurs.

    Returns (lengths, patterns, uses, sequences used, bound); no packing needs fewer sequences than bound. In each turn the
    knapsack's dynamic program prices patterns: with prices at which the dearest pattern is worth 1, all pieces together are worth no more than the fewest sequences,
    which is the bound; and for each length the dearest pattern that holds it joins the known ones. Then both sides move by multiplicative weights, each step taken at the point
    where a first one would lead: uses grow where a pattern is worth over 1, prices where a length is held too seldom; the second half of the steps is averaged.
    It ends when uses and bound are within GAP of each other, or nothing has got better for some turns.
    """
    lengths = np.array(sorted(counts), np.int64)
    need, at, m = np.array([counts[int(k)] for k in lengths], float), {int(k): i for i, k in enumerate(lengths)}, len(lengths)
    known: dict[tuple[int, ...], float] = defaultdict(float)
    for held, n in start:
        known[tuple(sorted(at[k] for k in held))] += n
    patterns, price, bound, better = list(known), lengths / size, 0.0, 0
    uses = np.array([known[p] for p in patterns])
    least, kept = float(uses.sum()), dict(zip(patterns, uses))
    for turn in range(TURNS):
        price = _rising(price, need)
        taken = best_values(price, lengths, size)
        worth = float(price[best_pattern(taken, lengths, size)].sum())
        bound, price = max(bound, float(need @ price) / worth), price / worth
        if least <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)) or turn - better > PATIENCE:
            break
        there = set(patterns)
        for i in range(m):
            pattern = tuple(sorted([i, *best_pattern(taken, lengths, size - int(lengths[i]))]))
            if pattern not in there:
                there.add(pattern)
                patterns.append(pattern)
        which = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        held = np.concatenate([np.array(p, np.int64) for p in patterns])
        most, fair = np.zeros(len(patterns)), np.full(len(patterns), np.inf)
        np.maximum.at(most, which, need[held])
        np.minimum.at(fair, which, (need / np.bincount(held, minlength=m))[held])
        now = fair * 0.1
        now[: len(uses)] = np.maximum(uses, 0.01 * fair[: len(uses)])

        def pull(uses, price):
            worth, had = np.bincount(which, price[held], len(patterns)), np.bincount(held, uses[which], m)  # noqa: B023
            return np.exp(STEP * (worth - 1) / np.maximum(worth, 1)), np.exp(STEP * (need - had) / np.maximum(need, had))

        sums, asked = np.zeros(len(patterns)), price
        total = np.zeros(m)
        for step in range(STEPS):
            u, p = pull(now, asked)
            u, p = pull(np.minimum(now * u, most), asked * p)
            now, asked = np.minimum(now * u, most), asked * p
            if step >= STEPS // 2:
                sums, total = sums + now, total + asked
        uses, price = sums / (STEPS - STEPS // 2), total / (STEPS - STEPS // 2)
        short = np.maximum(0, need - np.bincount(held, uses[which], m))
        found = float(uses.sum() + 1.2 * (short @ lengths) / size)
        if found < least:
            least, kept, better = found, dict(zip(patterns, uses)), turn
        elif found > least * 1.02:  # went astray
            uses = np.array([kept.get(p, 0.0) for p in patterns])
        # patterns that are hardly used and not worth it are forgotten
        alive = (uses > 1e-3) | (np.bincount(which, price[held], len(patterns)) > 0.99)
        patterns, uses = [p for p, on in zip(patterns, alive) if on], uses[alive]
    return lengths, list(kept), np.array(list(kept.values())), least, bound


def configured(counts: dict[int, int], size: int = SEQUENCE, again: int = AGAIN) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(sequences, bound) for a histogram of lengths: (lengths in order, number of such sequences), and the number that no packing can go below.

    The program starts from full sequences, or from best fit where that needs fewer. Its uses are rounded down, the pieces that this leaves are packed
    in the same way, and the result counts unless what it started from is no worse.
    """
    left = {k: n for k, n in counts.items() if n}
    if not left:
        return [], 0.0
    start = min((_full_first(left, size), fill(dict(left), size)), key=_used)
    lengths, patterns, uses, least, bound = cover(left, start, size)
    if least >= _used(start) * (1 - 1e-4) or not again:
        return start, bound
    order = np.argsort(-uses)
    # the longest piece first: rounding hands on what a pattern loses to the next one with the same longest piece
    made = _rounded(lengths, {tuple(reversed(patterns[k])): float(uses[k]) for k in order}, left)
    made += configured(left, size, again - 1)[0]
    return (made if _used(made) < _used(start) else start), bound


def configure(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram of lengths: (lengths in order, number of such sequences)."""
    return configured(counts, size)[0]


def _slots(patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank that each run of slots takes, the first sequence of the run, and the place in it."""
    taken, found, base = defaultdict(int), defaultdict(list), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            found[length].append((taken[length], base, offset))
            taken[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}


def pack(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Only the histogram (at most `size` numbers) reaches the driver. Pieces of one length are numbered without
    bringing them together: by bucket of a hash, with the counts of the buckets before; so any
    length may hold most of all pieces. A null or empty text is the end id alone; an empty table gives no rows. Rows that repeat an id are documents of their own,
    pieces of one length are taken in the order of a hash and then of their rows, and other columns are ignored, whatever their names.
    """
    made = stage(pieces(docs, path, text, id_col, size), "pieces")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(configure(counts, size))
    buckets = max(1, math.isqrt(sum(counts.values())))
    made = made.withColumn("bucket", F.pmod(F.xxhash64(ROW, "piece"), F.lit(buckets)))
    sizes = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(ROW, "piece"))
    ranked = made.withColumn("place", place).join(bases, ["length", "bucket"]).select("id", "piece", "start", "length", "crc", (F.col("base") + F.col("place") - 1).alias("rank"))

    def assign(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                first, base, at = slots[int(k)]
                j = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], offset[rows] = base[j] + rank[rows] - first[j], at[j]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_tasks(ranked, assign, f"doc_id {made.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
