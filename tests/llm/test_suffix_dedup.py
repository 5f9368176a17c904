import random
from collections import Counter

import numpy as np
import pytest

from buildproof.llm import suffix_dedup
from buildproof.llm.suffix_array import repeated_starts, suffix_array
from buildproof.llm.suffix_dedup import anchors, drop_repeats, remove_repeats


def plain(texts, depth=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    passages = [make(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [make(rng.randint(0, 900)) for _ in range(60)]
    for k in range(40):
        p = rng.choice(passages)
        texts.append(make(rng.randint(0, 300)) + p + make(rng.randint(0, 300)) + (p if k % 7 == 0 else ""))
    hot = make(230)
    texts += [make(rng.randint(0, 60)) + hot + make(rng.randint(0, 60)) for _ in range(60)]
    return texts + [texts[0], texts[3], texts[3], None, "", "x" * 1000, "ab" * 101 + "q", "short", make(9000)]


@pytest.mark.parametrize("crowd", [1000, 5, 0])
def test_removal_matches_plain_form(spark, crowd):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, x string")
    got = {r.id: (r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in remove_repeats(docs, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_long_texts_are_cut_into_blocks(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2048)
    monkeypatch.setattr(suffix_dedup, "_LOW", np.uint64(4095))
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 199, 200, 5000, 300)]
    starts = {k: [] for k in range(len(texts))}
    for k, lo, hi, _, _ in anchors(texts):
        for a, b, c in zip(k.tolist(), lo.tolist(), hi.tolist()):
            starts[a] += range(b, c + 1)
    assert all(sorted(starts[k]) == list(range(max(len(t) - 199, 0))) for k, t in enumerate(texts))


def test_suffix_array_is_in_order():
    rng = random.Random(2)
    for alphabet in (b"ab", b"a", bytes(range(256))):
        for _ in range(30):
            parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4)]
            text = np.array([s for p in parts for s in [*(b + 1 for b in p), 0]], np.int16)
            order = [i for i in suffix_array(text, 200).tolist() if text[i]]
            part = lambda i: tuple(text[i : i + int(np.argmin(text[i:]))].tolist())
            assert [part(i) for i in order] == sorted(part(i) for i in order)


def test_weights_count():
    assert [s.tolist() for s in repeated_starts([b"abcdef", b"xabcx", b"zzzz"], [1, 1, 2], 3)] == [[0], [1], [0, 1]]


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "t" * 500, 500), (1, None, None), (None, "u" * 100, 100), (2, "é" * 300 + "end", 303)], "doc_id long, text string, n_chars long")
    got = sorted([(r.doc_id, r.text, r.n_chars) for r in drop_repeats(docs).collect()], key=str)
    assert got == sorted([(1, "", 0), (1, None, None), (None, "u" * 100, 100), (2, "end", 3)], key=str)
    assert drop_repeats(docs.limit(0)).count() == 0
