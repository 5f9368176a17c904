"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, slices

#: Labelled documents used for training, at most; the bound of the sample.
TRAIN_DOCS = 4000
FOLDS = 4
#: Hash buckets of words, and how many of them a model keeps.
BUCKETS, KEPT = 1 << 18, 3000
REMEMBERED, LONG_WORD = 300_000, 64
#: Lengths of the beginnings of words that are features too.
STEMS = (3, 4, 5, 6, 7)

_LETTERS = bytes(b if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_words: dict[bytes, tuple[int, ...]] = {}


def _buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings, which carry the stem in inflected languages."""
    chars = word.decode(errors="replace")
    return (zlib.crc32(word) % BUCKETS, *[zlib.crc32(f"{chars[:k]}-".encode()) % BUCKETS for k in STEMS if k <= len(chars)])


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the distinct words of a whole text and of their beginnings, a few shares that describe its form)."""
    text = text or b""
    words = text.translate(_LETTERS).lower().split()
    distinct = set(words)
    if len(_words) + len(distinct) > REMEMBERED:
        _words.clear()
    long = {w: _buckets(w) for w in distinct if len(w) > LONG_WORD}  # not remembered, so that memory is bounded in bytes
    for w in distinct.difference(_words, long):
        _words[w] = _buckets(w)
    buckets = np.array(sorted(set().union(*long.values(), *[_words[w] for w in distinct if w not in long])), np.int32)
    n = max(len(text), 1)
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    signs = len(text.translate(None, bytes(b for b in range(256) if chr(b).isalnum() or b >= 128 or b in b" \t\n\r.,")))
    shape = [upper / n, signs / n, len(distinct) / max(len(words), 1), min(np.log1p(len(words)) / 10, 2.0), sum(map(len, words)) / n, text.count(b"|") / n]
    return buckets, np.array(shape)


class Linear:
    """Logistic regression on the word buckets that tell the classes apart best, and on dense columns."""

    def fit(self, docs: list[np.ndarray], dense: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> "Linear":
        counts = [np.bincount(np.concatenate([docs[k] for k in np.flatnonzero(y == c)] or [np.zeros(0, np.int32)]).astype(np.int64), minlength=BUCKETS) for c in (0, 1)]
        n1, n0 = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
        p1, p0 = (counts[1] + 1) / (n1 + 2), (counts[0] + 1) / (n0 + 2)
        pooled = (counts[0] + counts[1] + 2) / (n0 + n1 + 4)
        score = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
        score[counts[0] + counts[1] < 3] = 0
        best = np.argsort(-score, kind="stable")[:KEPT]
        best = best[score[best] > 2.5]
        column = np.full(BUCKETS, -1, np.int32)
        column[best] = np.arange(len(best))
        self.mean, self.spread = dense.mean(0), dense.std(0) + 1e-6
        z = (dense - self.mean) / self.spread
        rows, cols = [], []
        for k, d in enumerate(docs):
            c = column[d]
            c = c[c >= 0]
            rows.append(np.full(len(c), k))
            cols.append(c)
        rows, cols = np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])
        weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
        w, v, bias = np.zeros(len(best)), np.zeros(dense.shape[1]), 0.0
        params = [w, v, np.zeros(1)]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            margin = np.bincount(rows, weights=params[0][cols], minlength=len(y)) + z @ params[1] + params[2][0]
            d = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
            grads = [np.bincount(cols, weights=d[rows], minlength=len(best)) + decay * params[0], z.T @ d + decay * params[1], np.array([d.sum()])]
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        order = np.argsort(best)
        self.buckets, self.w, self.v, self.bias = best[order].astype(np.int32), params[0][order], params[1], float(params[2][0])
        self._table = None
        return self

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def probas(self, buckets: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probability of each document: one sparse product for all of them. buckets: of one after the other, sizes[k] of document k."""
        if self._table is None:
            self._table = np.zeros(BUCKETS)
            self._table[self.buckets] = self.w
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=self._table[buckets], minlength=len(sizes))
        margin = sums + ((dense - self.mean) / self.spread) @ self.v + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int64), np.array([len(d) for d in docs], np.int64)


class Chain:
    """One linear model per category, in order; model k sees the probabilities of categories 0..k-1 as well.

    For training these are out-of-fold: each comes from a model that has not seen the document. The
    threshold of a category is the one that serves its out-of-fold probabilities best (F1).
    """

    def fit(self, docs: list[np.ndarray], shape: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 3) -> "Chain":
        self.names, self.models, self.thresholds = names, [], []
        fold = np.random.default_rng(seed).permutation(len(docs)) % FOLDS
        dense = shape
        for k in range(len(names)):
            y, unseen = labels[:, k], np.zeros(len(docs))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(inside) and len(outside):
                    model = Linear().fit([docs[i] for i in inside], dense[inside], y[inside])
                    unseen[outside] = model.probas(*_joined([docs[i] for i in outside]), dense[outside])
            self.models.append(Linear().fit(docs, dense, y))
            self.thresholds.append(best_threshold(unseen, y))
            dense = np.column_stack((dense, unseen))
        return self

    def probas(self, docs: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        """documents x categories"""
        buckets, sizes = _joined(docs)
        for model in self.models:
            shape = np.column_stack((shape, model.probas(buckets, sizes, shape)))
        return shape[:, shape.shape[1] - len(self.models) :]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest step between scores at which F1 is greatest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    if not len(y) or not y.any():
        return 1.0
    last = np.append(p[order][:-1] > p[order][1:], True)
    k = int(np.where(last, f1, -1).argmax())
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", id_col: str = "doc_id", most: int = TRAIN_DOCS) -> Chain | None:
    """A chain learned from labelled documents; None if there are none. At most `most` labels, those whose id hashes lowest, are used.

    categories: name and 0/1 column of labels, in the order of the chain; rows with a null in any are left out. Labels that repeat an id count as one, positive
    if any is. Ties of the hash go by id. Other columns of both tables are ignored.
    """
    y = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).dropna()
    sample = y.groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))]).orderBy(F.xxhash64("id", F.lit(29)), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(sample), "id")
    k = len(categories)

    def read(batches):
        for b in batches:
            made = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([m[0].tolist() for m in made], pa.list_(pa.int32())), pa.array([m[1].tolist() for m in made], pa.list_(pa.float64())), *[b.column(2 + i).cast(pa.int32()) for i in range(k)]], names=["id", "buckets", "shape", *[f"y{i}" for i in range(k)]])

    found = rows.mapInArrow(read, "id string, buckets array<int>, shape array<double>, " + ", ".join(f"y{i} int" for i in range(k))).toArrow()
    if not found.num_rows:
        return None
    got = sorted(found.to_pylist(), key=lambda r: (r["id"], r["buckets"]))
    return Chain().fit([np.array(r["buckets"], np.int32) for r in got], np.array([r["shape"] for r in got]), np.array([[r[f"y{i}"] for i in range(k)] for r in got]), list(categories))


def score(docs: DataFrame, chain: Chain | None, names: list[str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, and p_<name> and is_<name> of every category, for every whole text.

    A text that is null or without a word has probability 0 in all of them, as has any text when nothing could be learned.
    Rows are scored one by one, so repeated rows and ids get the same; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    fields = [f"p_{n}" for n in names] + [f"is_{n}" for n in names]

    def run(batches):
        for b in slices(batches):
            p = np.zeros((b.num_rows, len(names)))
            made = [features(t) for t in b.column(1).to_pylist()] if chain else []
            if some := [k for k, (buckets, _) in enumerate(made) if len(buckets)]:
                p[some] = chain.probas([made[k][0] for k in some], np.array([made[k][1] for k in some]))
            flags = p >= (np.array(chain.thresholds) if chain else 2.0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in p.T], *[pa.array((f & (c > 0)).tolist(), pa.bool_()) for f, c in zip(flags.T, p.T)]], names=["id", *fields])

    return in_tasks(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"`{f}` {'double' if f.startswith('p_') else 'boolean'}" for f in fields))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_poor, p_toxic, is_poor, is_toxic: poor quality first, then toxicity given that.

    One row per row of docs, repeated ids too; a null or empty text is scored as one without words; other columns are ignored, whatever their names. Where no
    label can be used all probabilities are 0; an empty table gives no rows.
    """
    categories = {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return score(docs, train(docs, labels, categories), list(categories)).withColumnRenamed("id", "doc_id")
