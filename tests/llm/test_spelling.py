import random
import re
import zlib
from collections import Counter

import pytest

from buildproof.llm import spelling
from buildproof.llm.registry import QUERIES
from buildproof.llm.spelling import Acceptor, follow, near_pairs, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one edit makes b of a: what is left between the shared start and the shared end."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(n):
    words = sorted(n)
    partners = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                partners[a].append(b)
                partners[b].append(a)
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(partners[w]), n[form[w]] if form[w] else None) for w in words)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def fixture():
    rnd = random.Random(5)
    syllables = ["ma", "no", "ti", "re", "zu", "é", "ÿ×", "a", "b"]
    base = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 6))) for _ in range(150)]

    def damaged(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1 :]])

    words = base + [damaged(rnd.choice(base)) for _ in range(400)]
    words += [damaged(rnd.choice(words)) for _ in range(400)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "ababab", "bababa", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    texts = []
    for d in range(250):
        picked = [rnd.choice(words[: rnd.choice([20, 200, len(words)])]) for _ in range(40)]
        texts.append(rnd.choice([" ", "1", "\n", "ő", "𝒳"]).join(w.upper() if w.isascii() and rnd.random() < 0.3 else w for w in picked))
    rows = [(d, t) for d, t in enumerate(texts)] + [(900, None), (901, ""), (902, " 12 …"), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    return rows + [(903 + k, " ".join(words[-9:])) for k in range(4)]


@pytest.mark.parametrize("most", [4096, 8])
def test_variants_match_brute_force(spark, monkeypatch, most):
    """With room for 8 words in a state nearly all states are split, some of them several times."""
    rows = fixture()
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    table = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n int, word string")
    want = brute(counted(rows))
    assert len(want) > 300 and sum(1 for r in want if r[1] and r[1] != r[2]) > 10
    assert got(spelling_variants(table)) == want


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_spelling_variants"](spark, sf_dir)) == brute(counted(rows))


def test_no_rows(spark):
    table = spark.createDataFrame([(1, None), (2, "ab cd")], "doc_id long, text string")
    assert spelling_variants(table).count() == 0 and spelling_variants(table.limit(0)).count() == 0


def test_states_are_shared_and_pairs_come_once():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([6, 7]))) for _ in range(600)})
    acceptor = Acceptor()
    found = near_pairs(words, 6, acceptor)
    want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == 6 and near(a, b) and (len(b) == 7 or i < j))
    assert sorted((i, j) for i, j in found) == want
    assert len(acceptor.arcs) < len({w[:k] for w in words for k in range(8)}) / 3  # minimised: far fewer states than prefixes


def test_long_ways_to_the_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w0"), ("b", "c")], "word string, form string")
    assert {r.word: r.root for r in follow(forms).collect()} == {f"w{k}": "w37" for k in range(37)} | {"a": "w37", "b": "c"}
