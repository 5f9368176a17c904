import random

import pytest
from pyspark.sql import functions as F

from buildproof.llm.line_dedup import drop_repeated_lines


def plain(rows, run):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        for i in range(len(lines) - run + 1):
            part = tuple(lines[i : i + run])
            if part in seen:
                gone[k] |= set(range(i, i + run))
            seen.add(part)
    out = []
    for k, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        out.append((i, None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone[k]), len(lines), len(gone[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_matches_plain_form(spark, run):
    rng = random.Random(run)
    rows = [(k, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (None, "a\nb\nc\nd"), (103, "hot\nline\nrun"), (103, "hot\nline\nrun"), (99, "x " * 30_000 + "\n" + "y\n" * 3000)]
    rows += [(200 + k, f"own {k}\nhot\nline\nrun\nend {k}") for k in range(50)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_lines string")
    found = drop_repeated_lines(docs, run=run)
    assert found.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows, run)
    assert drop_repeated_lines(docs.filter(F.lit(False)), run=run).count() == 0


def plain_with_words(rows, run, words):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        lines = rows[k][1].split("\n")
        for i in range(len(lines)):
            for n in range(1, run + 1):
                part = tuple(lines[i : i + n])
                if len(part) < n or (n < run and len(" ".join(part).split()) < words):
                    continue
                if part in seen:
                    gone[k] |= set(range(i, i + n))
                seen.add(part)
    return [(i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]), len(gone[k])) for k, (i, t) in enumerate(rows)]


def test_short_stretches_of_many_words_go_where_asked(spark):
    rng = random.Random(5)
    long, one, two = (" ".join(f"{name}{k}" for k in range(n)) for name, n in (("w", 60), ("x", 30), ("y", 30)))
    rows = [(0, f"a\n{long}\nb"), (1, f"c\n{long}\nd"), (2, long), (3, f"{one}\n{two}"), (4, f"e\n{one}\n{two}\nf"), (5, f"{one}\ng"), (6, f"{long}\n{long}")]
    rows += [(10 + k, "\n".join(rng.choice(["p q r", "s t", "u v w x", "y"]) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (50, 6):
        got = sorted((r.doc_id, r.text, r.n_removed) for r in drop_repeated_lines(docs, min_words=words).collect())
        assert got == plain_with_words(rows, 3, words)
    assert [t for i, t, _ in plain_with_words(rows, 3, 50)[:7]] == [f"a\n{long}\nb", "c\nd", "", f"{one}\n{two}", "e\nf", f"{one}\ng", ""]


def test_only_selected_lines_are_joined(spark):
    from buildproof.llm.common import ROW, numbered, settled
    from buildproof.llm.line_dedup import fingerprints, seeds

    rng = random.Random(9)
    texts = ["\n".join(f"line {rng.randint(0, 400)}" for _ in range(rng.randint(3, 150))) for _ in range(80)]
    docs = settled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = fingerprints(numbered(docs), "text", "doc_id", 3)
    windows = sum(t.count("\n") - 1 for t in texts)
    assert found.count() < 0.6 * windows
    assert found.select(ROW, "place").distinct().count() == found.count()
    starts = seeds(found, 3).select(ROW, F.explode("windows.start").alias("start"))
    assert starts.distinct().count() == windows  # no window is without a selected line


def test_matches_are_extended_over_blocks_and_verified(spark):
    from buildproof.llm.line_dedup import _blocks, _extended, repeated_runs
    from buildproof.llm.common import ROW, numbered, settled

    lines = [f"l{k}" for k in range(300)]
    docs = settled(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([f"own{k}" for k in range(70)] + lines[5:290] + ["end"]))], "doc_id long, text string"))
    runs = repeated_runs(docs).collect()
    assert [[tuple(x) for x in r.runs] for r in runs] == [[(70, 285)]]
    rows = numbered(docs)
    ids = {r.doc_id: r[ROW] for r in rows.select("doc_id", ROW).collect()}
    schema = f"{ROW} struct<file:bigint,index:bigint>, start int, len int, r0 struct<file:bigint,index:bigint>, s0 int"
    # one match is extended to all of its block that agrees; a false one is dropped
    matches = spark.createDataFrame([(ids[2], 100, 3, ids[1], 35), (ids[2], 10, 3, ids[1], 50)], schema)
    assert [(r["from"], r["len"]) for r in _extended(matches, _blocks(rows, "text", 3)).collect()] == [(70, 60)]


def test_extension_finds_most_of_a_run(spark, monkeypatch):
    """One seed for each stretch of a diagonal and block: without extension most repeated lines stay."""
    from buildproof.llm import line_dedup
    from buildproof.llm.common import ROW

    rng = random.Random(11)
    source = [f"line {k} {rng.random()}" for k in range(400)]
    texts = ["\n".join(source)] + ["\n".join([f"own {d} {k}" for k in range(rng.randint(0, 9))] + source[a : a + 60] + [f"end {d}"] + source[b : b + 5]) for d in range(40) for a, b in [(rng.randint(0, 300), rng.randint(0, 390))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(list(enumerate(texts)), 3)
    assert sorted([tuple(r) for r in drop_repeated_lines(docs).collect()], key=str) == want
    seeds = []

    def only_seeds(matches, blocks):
        found = line_dedup._seeds(matches).select(ROW, F.explode("seeds").alias("x")).select(ROW, F.col("x.start").alias("from"), "x.len")
        seeds.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "_extended", only_seeds)
    without = drop_repeated_lines(docs).collect()
    removed, all_ = sum(r.n_removed for r in without), sum(r[3] for r in want)
    windows = sum(max(0, t.count("\n") - 1) for t in texts)
    assert removed < 0.5 * all_ and all_ > 2000 and seeds[0] < 0.2 * windows
