"""A suffix array by two-stage sorting, and adjacent common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols in one sort key: nine bits each.
STEP = 7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, np.uint64(_inverse(int(_BASE))))]
    return _powers[0], _powers[1]


_SYMBOL = np.random.default_rng(5).integers(0, 1 << 64, 257, dtype=np.uint64)


def range_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end] for many ranges, the same for equal contents."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_SYMBOL[symbols] * up[: len(symbols)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def keys_of(text: np.ndarray, beyond: int) -> np.ndarray:
    """The next STEP symbols of every position as one number; zeros stand for what is beyond the end."""
    t = np.zeros(len(text) + beyond + 8, np.int64)
    t[: len(text)] = text
    two = (t[:-1] << 9) | t[1:]
    four = (two[:-2] << 18) | two[2:]
    three = (two[:-1] << 9) | t[2:]
    return (four[:-4] << 27)[: len(text) + beyond] | three[4:][: len(text) + beyond]


def _grouped_order(k: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by group, then k. Both sorts are of plain numbers, which is faster than one by two columns."""
    order = np.argsort(k)
    rank = np.empty(len(k), np.int64)
    rank[order] = np.arange(len(k))
    return np.argsort(group * len(k) + rank)


def sort_directly(at: np.ndarray, keys: np.ndarray, same: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols. same: a hash of those, which ends work on equal ones.

    Each step looks STEP symbols further at the suffixes still tied. Groups in which these agree are left as they are.
    """
    at = at[np.argsort(keys[at])]
    fresh = np.ones(len(at), bool)
    fresh[1:] = keys[at[1:]] != keys[at[:-1]]
    todo, done = np.arange(len(at)), STEP

    def open_ones(starts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Which members belong to groups of several different suffixes."""
        first = np.flatnonzero(starts)
        sizes = np.diff(np.append(first, len(starts)))
        tied = (sizes > 1) & (np.minimum.reduceat(w, first) != np.maximum.reduceat(w, first)) if len(first) else np.zeros(0, bool)
        return np.repeat(tied, sizes)

    todo = todo[open_ones(fresh, same[at])]
    while done < depth + STEP and len(todo):
        k = keys[at[todo] + done]
        starts = fresh[todo]
        group = np.cumsum(starts) - 1
        differs = np.zeros(len(todo), bool)
        differs[1:] = (k[1:] != k[:-1]) & ~starts[1:]
        varied = np.zeros(int(group[-1]) + 1, bool)
        varied[group[differs]] = True
        part = np.flatnonzero(varied[group])
        if len(part):
            kp, gp, places = k[part], group[part], todo[part]
            order = _grouped_order(kp, gp)
            at[places], kp = at[places][order], kp[order]
            fresh[places[1:]] |= (kp[1:] != kp[:-1]) & (gp[1:] == gp[:-1])
            keep = np.ones(len(todo), bool)
            keep[part] = open_ones(fresh[places], same[at[places]])
            todo = todo[keep]
        done += STEP
    return at


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a symbol later; the last is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    following = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    return (following < n - 1) & (text[following] < text[np.minimum(following + 1, n - 1)])


def suffix_array(text: np.ndarray, depth: int, same: np.ndarray | None = None, keys: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text (symbols 0 to 256, ending in a 0 that separates parts) in order of their first `depth` symbols.

    Stage one sorts only the suffixes that are smaller than their successors. Stage two scans the buckets
    of first symbols from the least up: what precedes a placed suffix and is larger than it takes the next place in the
    front of its own bucket. Suffixes that start at a separator come first, in any order.
    """
    n = len(text)
    keys = keys_of(text, depth + 2 * STEP) if keys is None else keys
    if same is None:
        at = np.arange(n)
        same = range_hashes(text, at, np.minimum(at + depth, n))
    rising = smaller_than_next(text) & (text > 0)
    direct = sort_directly(np.flatnonzero(rising), keys, same, depth)
    lead = text[direct]
    bounds = np.searchsorted(lead, np.arange(258))
    front: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        if c == 0:
            bucket = np.flatnonzero(text == 0)
        else:
            parts = front[c]
            run = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            parts = [run]
            while len(run):  # runs of one symbol: each step places the suffixes one symbol longer
                run = run[run > 0] - 1
                run = run[text[run] == c]
                parts.append(run)
            bucket = np.concatenate([*parts, direct[bounds[c] : bounds[c + 1]]])
            front[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = text[before]
        larger = symbol > c
        before, symbol = before[larger], symbol[larger]
        if len(before):
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
            for part in np.split(before, cut):
                front[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, text: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """How many symbols, up to depth, each suffix in order shares with the one before it (0 for the first)."""
    keys = keys_of(text, depth + 2 * STEP) if keys is None else keys
    out = np.zeros(len(order), np.int64)
    todo, done = np.arange(1, len(order)), 0
    while done < depth and len(todo):
        x = keys[order[todo] + done] ^ keys[order[todo - 1] + done]
        differ = x != 0
        bits = np.frexp(x[differ].astype(np.float64))[1]
        # rounding up to a power of two can add one bit; undo it
        bits -= (x[differ] >> np.maximum(bits - 1, 0)) == 0
        out[todo[differ]] = done + STEP - 1 - (bits - 1) // 9
        todo = todo[~differ]
        done += STEP
        out[todo] = done
    return np.minimum(out, depth)


def repeated_starts(parts: list[bytes], weights: list[int], depth: int) -> list[np.ndarray]:
    """For each part, the starts of its `depth`-byte strings that occur more than once in all parts, weights counted."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = joined.astype(np.int16) + 1
    text[ends] = 0
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    at, end = np.arange(len(text)), ends[owner]
    same = range_hashes(text, at, np.minimum(at + depth, end + 1))
    keys = keys_of(text, depth + 2 * STEP)
    order = suffix_array(text, depth, same, keys)
    order = order[order + depth <= end[order]]
    new = common_prefixes(order, text, depth, keys) < depth
    first = np.flatnonzero(new)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    if len(order):
        total = np.add.reduceat(np.asarray(weights, np.int64)[owner[order]], first)
        hit = np.sort(order[np.repeat(total > 1, np.diff(np.append(first, len(order))))])
        whose = owner[hit]
        cut = np.flatnonzero(whose[1:] != whose[:-1]) + 1
        for part in np.split(hit, cut) if len(hit) else []:
            k = owner[part[0]]
            out[k] = part - (ends[k] - sizes[k])
    return out
