import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from buildproof.llm.simhash import fingerprint, links, near_groups
from buildproof.llm.components import components


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    roots = list(range(len(fps)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 900):
        text = " ".join(rng.choice(["Äpfel", "the", "OF", "a\tb", "x" * 40]) for _ in range(n))
        assert fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)
    assert fingerprint(None) == 0


def test_links_connect_like_brute_force(spark):
    rng = random.Random(2)
    fps = set()
    for size in (1, 1, 3, 200):  # the last fills buckets beyond the limit
        center = rng.getrandbits(64)
        for _ in range(size):
            center_now = center
            for _ in range(rng.randint(0, 3)):
                center_now ^= 1 << rng.randrange(64)
            fps.add(center_now)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for limit in (2, 32, 10_000):
        found = {r.node: r.root for r in components(links(table, max_bucket=limit)).collect()}
        got = {}
        for f in signed:
            got.setdefault(found.get(f, f), set()).add(f)
        want = {}
        for f, c in zip(signed, plain_components(fps)):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_groups_on_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (7, "one"), (8, "ONE"), (9, "quite another text here"), (None, "one"), (9, "quite another text here")]
    got = {(r.id, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (4, 3), (3, 3), (7, 7), (8, 7), (None, 7), (9, 9)}
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(edges).collect()} == {0}
