"""Language ID: a convolutional network over bytes, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, settled, slices

#: Bytes of a window. A text is cut into windows from its start to its end.
WINDOW = 256
#: At most so many windows of each language, out of all windows of its labelled documents, are used for training; the bound of the sample.
TRAIN_WINDOWS = 3000
#: A text is rejected if no language has so large a share of its probability: there is no majority among the windows.
MAJORITY = 0.5
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
FOLDS = 5
UNKNOWN = "und"


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out and never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class ByteNet:
    """Byte embeddings, filters of several widths, the maximum of each over a window, a linear layer, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32)
        self.p["emb"][0] = 0  # padding
        self._tables = None

    def __getstate__(self):
        return {"langs": self.langs, "p": self.p, "_tables": None}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy; x: windows of bytes, y: index of the language."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        weight = len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(order), batch):
                rows = order[start : start + batch]
                bx, by = x[rows], y[rows]
                n = np.arange(len(rows))
                e = p["emb"][bx]
                pooled, at = [], []
                for w in WIDTHS:
                    conv = sum(e[:, o : WINDOW - w + 1 + o] @ p[f"w{w}"][o] for o in range(w))
                    at.append(conv.argmax(1))
                    pooled.append(np.take_along_axis(conv, at[-1][:, None], 1)[:, 0])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                d = _softmax(h @ p["out"] + p["bias"])
                d[n, by] -= 1
                d *= weight[by, None] / len(rows)
                g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
                dh = (d @ p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    part, weights = dh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"w{w}"])
                    for o in range(w):
                        seen = bx[n[:, None], at[k] + o]  # the byte under this offset of each filter's maximum
                        weights[o] = np.einsum("nfe,nf->ef", p["emb"][seen], part)
                        np.add.at(g["emb"], seen.ravel(), (part[:, :, None] * p[f"w{w}"][o].T).reshape(-1, EMBED))
                    g[f"w{w}"] = weights
                g["emb"][0] = 0
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self._tables = None

    def tables(self):
        """The filters' responses to byte pairs and single bytes: a convolution becomes two lookups and a sum."""
        if self._tables is None:
            one = {w: [self.p["emb"] @ self.p[f"w{w}"][o] for o in range(w)] for w in WIDTHS}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            self._tables = [(pair(one[w][0], one[w][1]), None if w == 2 else one[w][2] if w == 3 else pair(one[w][2], one[w][3])) for w in WIDTHS]
        return self._tables

    def windows_proba(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        """Probabilities of each window of bytes (n x WINDOW)."""
        out = []
        for start in range(0, len(x), step):
            b = x[start : start + step]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            pooled = []
            for w, (head, tail) in zip(WIDTHS, self.tables()):
                conv = head.take(pairs[:, : WINDOW - w + 1], 0)
                if w == 3:
                    conv += tail.take(b[:, 2:], 0)
                elif w == 4:
                    conv += tail.take(pairs[:, 2:], 0)
                pooled.append(conv.max(1))
            out.append(_softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def texts_proba(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all windows of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        lengths = np.diff(offsets)
        count = np.maximum(-(-lengths // WINDOW), 1)
        first = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros((len(lengths), len(self.langs)))
        block = 4096  # windows held at a time
        for a in range(0, int(first[-1]), block):
            b = min(a + block, int(first[-1]))
            owner = np.searchsorted(first, np.arange(a, b), "right") - 1
            start = offsets[owner] + (np.arange(a, b) - first[owner]) * WINDOW
            size = np.clip(offsets[owner + 1] - start, 0, WINDOW)
            at = start[:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < size[:, None]
            x = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
            np.add.at(out, owner, self.windows_proba(x) * np.maximum(size, 1)[:, None])
        return out / np.maximum(np.where(lengths > 0, lengths, 1), 1)[:, None]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_lang: int = TRAIN_WINDOWS) -> ByteNet | None:
    """A network learned from the text and label of labelled documents outside fold 0; None if there are none.

    The sample is bounded: per_lang windows of each language at most. Every window of every such text may be in it, beginnings
    and ends alike, by its hash; documents count alike, so one of many windows gives no more than others.
    """
    windows = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).filter((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(1.2 * per_lang / counts[k] * (1 << 30)))])
    spot = lambda k: F.xxhash64("id", k, F.lit(17))
    low = F.filter(F.sequence(F.lit(0), windows - 1), lambda k: F.pmod(spot(k), F.lit(1 << 30)) * windows < F.element_at(share, F.col("lang")))
    each = F.transform(low, lambda k: F.struct(spot(k).alias("spot"), F.substring(F.col("text"), k * WINDOW + 1, F.lit(WINDOW)).alias("window")))
    rows = labelled.select("lang", F.explode(each).alias("x")).select("lang", "x.spot", "x.window").collect()
    taken, x, y = dict.fromkeys(langs, 0), [], []
    for r in sorted(rows, key=lambda r: (r.spot, r.lang, bytes(r.window))):
        if taken[r.lang] < per_lang:
            taken[r.lang] += 1
            x.append(np.frombuffer(bytes(r.window).ljust(WINDOW, b"\0"), np.uint8))
            y.append(langs.index(r.lang))
    net = ByteNet(langs)
    net.fit(np.array(x), np.array(y))
    return net


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score (columns of these names are replaced).

    A text that is null or has no letter gets `und` with score 1; without a network every other gets `und`
    with score 0. The whole text is read, window by window; the score is the mean probability. Each row is predicted
    by itself, so repeated rows and ids get the same; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("lang_pred", "score")
    letter = "letter"
    while letter in docs.columns:
        letter += "_"
    rows = docs.withColumn(letter, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    target = to_arrow_schema(schema)
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches, 2048):
            letters = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            pred, score = np.full(b.num_rows, UNKNOWN, object), np.where(letters, 0.0, 1.0)
            if net is not None and letters.any():
                texts = pa.concat_arrays([b.column(at).cast(pa.large_binary()).filter(pa.array(letters))])
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
                proba = net.texts_proba(np.frombuffer(texts.buffers()[2], np.uint8), offsets)
                best = proba.argmax(1)
                pred[letters] = np.array(net.langs, object)[best]
                score[letters] = np.clip(proba[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns[:-1], target)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=target)

    return in_tasks(rows, run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Train on the labelled documents of the table and predict for all of them: predict() says what each case gives."""
    docs = settled(docs)
    return predict(docs, train(docs, text, lang, id_col), text)


def drop_unknown(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", majority: float = MAJORITY) -> DataFrame:
    """The documents whose language is told: a learned language is predicted, with a majority of the probability. All columns stay as they are.

    Texts that are null or have no letter go, as do those of which no language has a majority. Where no labelled document
    outside fold 0 is there to learn from, nothing can be told of a text with letters, and it stays. An empty table gives no rows.
    """
    docs = settled(docs)
    net = train(docs, text, lang, id_col)
    safe = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no name of the table can clash with the prediction's
    found = predict(safe, net, f"c{docs.columns.index(text)}")
    told = F.col("lang_pred") != UNKNOWN
    keep = told & (F.col("score") >= majority) if net is not None else F.col(f"c{docs.columns.index(text)}").rlike(r"\p{L}")
    return found.filter(keep).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
