"""Spelling variant grouping: a minimised acceptor of words composed with a one-edit transducer and the acceptor again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard_since, in_tasks, settled, stage, staged_now

MIN_LETTERS, MIN_COUNT = 5, 3
#: One occurrence of a run in so many loses a letter, as fixed by its hash.
DAMAGE = 97
#: Words of one initial state that a task holds at once, and their code points; a larger state is split by further letters.
MOST_WORDS, MOST_LETTERS = 4096, 1 << 22
#: States and pairs kept by the acceptor of a task before it starts a new one.
MOST_STATES, MOST_PAIRS = 50_000, 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: runs of letters of all whole texts, lower-cased in A-Z only, some with a letter lost, that are long and frequent enough.

    A null text has no words; a null id counts as an empty text in the hash.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))
    words = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    words = words.withColumn("h", F.crc32(F.concat("id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = words.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """A minimised acyclic acceptor of words of equal length from many initial states, and its composition with one edit.

    State 0 accepts nothing but the end. Every other state has arcs in the order of code points: (letter, next state,
    number of words before). Words that a state accepts are known by their rank. Equal right languages are one state, so
    whatever was composed for a state serves all words and all initial states that lead to it.
    """

    def __init__(self):
        self.arcs, self.size, self.known = [()], [1], {}
        self._subs, self._inserts, self._common, self.pairs = {}, {}, {}, 0

    def add(self, words: list[str]) -> int:
        """The initial state that accepts some sorted, distinct words of one length."""
        length, last = len(words[0]), words[0]
        open_ = [[] for _ in range(length)]
        for word in [*words[1:], None]:
            same = 0
            if word is not None:
                while word[same] == last[same]:
                    same += 1
            state = 0
            for depth in range(length - 1, same - 1, -1):
                open_[depth].append((last[depth], state))
                if depth > same or word is None:
                    state, open_[depth] = self._state(tuple(open_[depth])), []
            last = word
        return state

    def _state(self, arcs: tuple) -> int:
        state = self.known.get(arcs)
        if state is None:
            state, before, full = len(self.arcs), 0, []
            for letter, target in arcs:
                full.append((letter, target, before))
                before += self.size[target]
            self.arcs.append(tuple(full))
            self.size.append(before)
            self.known[arcs] = state
        return state

    def common(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranks in a and in b of the words that both accept."""
        if a == b:
            return [(i, i) for i in range(self.size[a])]
        found = self._common.get((a, b))
        if found is None:
            # one shared letter at a time without recursion, as words may be very long
            found, todo = [], [(a, b, 0, 0)]
            while todo:
                x, y, i, j = todo.pop()
                if x == y:
                    found += [(i + k, j + k) for k in range(self.size[x])]
                    continue
                other = {letter: (target, before) for letter, target, before in self.arcs[y]}
                for letter, target, before in self.arcs[x]:
                    if letter in other:
                        todo.append((target, other[letter][0], i + before, j + other[letter][1]))
            self._common[a, b] = found
            self.pairs += len(found) + 1
        return found

    def _here(self, state: int) -> list[tuple[int, int]]:
        """Pairs that differ in the first letter alone."""
        found, arcs = [], self.arcs[state]
        for k, (_, x, i) in enumerate(arcs):
            for _, y, j in arcs[k + 1 :]:
                found += [(i + p, j + q) for p, q in self.common(x, y)]
        return found

    def _longer_here(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs where b's word has one letter more at the very front, and goes on otherwise than with a's first letter."""
        found = []
        for letter, target, before in self.arcs[b]:
            if a == target == 0:
                found.append((0, before))
            then = {c: (t, n) for c, t, n in self.arcs[target]}
            for c, t, n in self.arcs[a]:
                if c != letter and c in then:
                    found += [(n + p, before + then[c][1] + q) for p, q in self.common(t, then[c][0])]
        return found

    def _composed(self, kept: dict, start: tuple, here, below) -> list:
        """The pairs of `start`: those of an edit here, and those of every state below, each composed once. `start` ends in the letters in which an edit may begin."""
        todo = [start]
        while todo:
            now = todo[-1]
            if now in kept:
                todo.pop()
                continue
            nexts = below(*now) if now[-1] > 1 else []
            missing = [n for n, _, _ in nexts if n not in kept]
            if missing:
                todo += missing
                continue
            found = here(*now[:-1]) if now[-1] > 0 else []
            for n, i, j in nexts:
                found += [(i + p, j + q) for p, q in kept[n]]
            kept[now] = found
            self.pairs += len(found) + 1
            todo.pop()
        return kept[start]

    def replaced(self, state: int, within: int) -> list[tuple[int, int]]:
        """Ranks of words of a state that differ in one of the first `within` letters and in no other, the smaller word first."""
        below = lambda s, w: [((t, w - 1), n, n) for _, t, n in self.arcs[s]]
        return self._composed(self._subs, (state, within), self._here, below)

    def inserted(self, a: int, b: int, within: int) -> list[tuple[int, int]]:
        """Ranks of a word of a and a word of b that has one letter more; they part within the first `within` letters."""

        def below(x, y, w):
            other = {c: (t, n) for c, t, n in self.arcs[y]}
            return [((t, other[c][0], w - 1), n, other[c][1]) for c, t, n in self.arcs[x] if c in other]

        return self._composed(self._inserts, (a, b, within), self._longer_here, below)


def near_pairs(words: list[str], shorter: int, acceptor: Acceptor, start: int = 0, end: int = 0, within: int | None = None) -> list[tuple[int, int]]:
    """Places of near words, of which one at least has `shorter` letters. All words share the first `start` and the last `end` letters; pairs part within `within` letters more."""
    order = sorted(range(len(words)), key=words.__getitem__)
    short, long = ([k for k in order if len(words[k]) == n] for n in (shorter, shorter + 1))
    inner = lambda places: [words[k][start : len(words[k]) - end] for k in places]
    if not short:
        return []
    most = shorter + 1 - start - end if within is None else within
    a = acceptor.add(inner(short))
    found = [(short[i], short[j]) for i, j in acceptor.replaced(a, most)]
    if long:
        found += [(short[i], long[j]) for i, j in acceptor.inserted(a, acceptor.add(inner(long)), most)]
    return found


#: A word's initial state: letters of the shorter word of a pair; letters shared at the start and the end; pairs have to part before letter `cap`.
KEY = "key string, s int, p int, q int, cap int, word string, n long"
NO_CAP = (1 << 31) - 1


def _keyed(words: DataFrame, s, p, q, cap) -> DataFrame:
    """Every word under the two initial states next to (s, p, q, cap): the free letters' first half shared, or their last half.

    A pair with one edit shares all but one of the free letters of its shorter word, in front of the edit and behind it: so the first r // 2 or the last
    r - r // 2. It belongs under the second only if it parts before letter p + r // 2, so every pair belongs under one state.
    """
    half = F.floor((s - p - q) / 2).cast("int")
    front = F.struct(s.alias("s"), (p + half).alias("p"), q.alias("q"), cap.alias("cap"))
    back = F.struct(s.alias("s"), p.alias("p"), (s - p - half).alias("q"), F.least(cap, p + half).alias("cap"))
    out = words.select("word", "n", F.explode(F.array(front, back)).alias("at")).select("word", "n", "at.*").filter("p < cap")
    size = F.length("word")
    key = F.concat_ws(" ", "s", "p", "q", "cap", F.substring("word", F.lit(1), F.col("p")), F.substring("word", size - F.col("q") + 1, F.col("q")))
    return out.select(key.alias("key"), "s", "p", "q", "cap", "word", "n")


def _sized(keyed: DataFrame) -> DataFrame:
    """Keyed words whose initial state has several words, with whether they are too many for one task."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("letters"), F.min(F.length("word") - F.col("s")).alias("least")).filter("words > 1 and least = 0")
    return keyed.join(apart(sizes, "key"), "key").withColumn("large", (F.col("s") - F.col("p") - F.col("q") > 1) & ((F.col("words") > MOST_WORDS) | (F.col("letters") > MOST_LETTERS))).drop("words", "letters", "least")


def initial_states(words: DataFrame, min_letters: int = MIN_LETTERS) -> list[DataFrame]:
    """Tables of KEY: words by initial state, none of which has more words than a task can hold.

    A word of l letters may be the shorter of a pair or the longer, so it stands under l and l - 1. States that are too large are split by half of
    their free letters again, until one free letter is left: then they are bounded by the alphabet.
    """
    size = F.length("word")
    as_pairs = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).filter(F.col("s") >= min_letters)
    zero = F.lit(0)
    now = stage(_sized(_keyed(as_pairs.select("word", "n", "s"), F.col("s"), zero, zero, F.lit(NO_CAP))), "states")
    out = []
    while True:
        out.append(now.filter("not large").drop("large"))
        large = now.filter("large")
        if large.isEmpty():
            return out
        now = stage(_sized(_keyed(large, F.col("s"), F.col("p"), F.col("q"), F.col("cap"))), "states")


def _links(states: DataFrame) -> DataFrame:
    """word, near, best_n, best: for every word and initial state the number of near words, the greatest count of one, and the least such word."""

    def links(key: tuple, words: list[str], counts: list[int], acceptor: Acceptor):
        s, p, q, cap = key
        near, best = [0] * len(words), [None] * len(words)
        for i, j in near_pairs(words, s, acceptor, p, q, None if cap == NO_CAP else cap - p):
            for x, y in ((i, j), (j, i)):
                near[x] += 1
                mine = (-counts[y], words[y])
                if best[x] is None or mine < best[x]:
                    best[x] = mine
        hit = [k for k in range(len(words)) if near[k]]
        return [words[k] for k in hit], [near[k] for k in hit], [-best[k][0] for k in hit], [best[k][1] for k in hit]

    def run(batches):
        acceptor, held, last = Acceptor(), ([], []), None
        out, names = [[], [], [], []], ["word", "near", "best_n", "best"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def close():
            nonlocal acceptor
            for k, x in enumerate(links(last[1], *held, acceptor)):
                out[k].extend(x)
            if len(acceptor.arcs) > MOST_STATES or acceptor.pairs > MOST_PAIRS:
                acceptor = Acceptor()

        for b in batches:
            key, s, p, q, cap, word, n = (c.to_pylist() for c in b.columns)
            for k in range(b.num_rows):
                if last is None or key[k] != last[0]:
                    if last is not None:
                        close()
                    held, last = ([], []), (key[k], (s[k], p[k], q[k], cap[k]))
                held[0].append(word[k])
                held[1].append(n[k])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                for x in out:
                    x.clear()
        if last is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    parts = states.repartition(F.col("key")).sortWithinPartitions("key").select("key", "s", "p", "q", "cap", "word", "n")
    return in_tasks(parts, run, "word string, near long, best_n long, best string")


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the last form that following forms leads to. forms: word, form, without cycles. The way halves in each round."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of word_counts().

    Words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its near word of greatest n (ties: least in the order of
    code points) if that n is at least twice its own; root is where forms lead. Null texts have no words, repeated rows count again, other columns are
    ignored, an empty table gives no rows; min_letters is 3 at least, as near words must share letters to meet.

    The words of one initial state (those that share letters at the start, the end or both) meet in one task, which composes their acceptor with one edit and itself.
    """
    if min_letters < 3:
        raise ValueError("words need three letters at least")
    before = staged_now()
    words = stage(word_counts(settled(docs), text, id_col, min_letters, min_count, damage), "words")
    links = None
    for states in initial_states(words, min_letters):
        found = _links(states)
        links = found if links is None else links.unionByName(found)
    best = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), "best"))
    near = links.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.*")
    out = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
    out = out.select("word", F.when(F.col("has"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    out = stage(out, "forms")
    roots = follow(out.filter("form is not null").select("word", "form"))
    done = stage(out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard_since(before, done)
    return done
