from collections import defaultdict

from buildproof.llm.exact_dedup import drop_copies, exact_groups

ROWS = [(3, "a b"), (1, "ab"), (2, "a b\n"), (4, None), (5, ""), (6, " "), (7, "long " * 20_000), (8, "long" * 20_000), (None, "ab"), (9, "x"), (9, "x"), (10, "a b")]


def plain(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        t = t or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0, k))
    out = {}
    for members in groups.values():
        best = min(members)
        for m in members:
            out[m[3]] = (rows[best[3]][0], len(members), m[3] == best[3])
    return sorted([(rows[k][0], *v) for k, v in out.items()], key=str)


def test_groups_match_plain_form(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, len string")
    got = sorted([(r.id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()], key=str)
    assert got == plain(ROWS)


def test_drop_copies_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, full string")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == sorted(r[0] for r in plain(ROWS) if r[3])
    assert drop_copies(docs.limit(0)).count() == 0
