from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from buildproof.llm.langid import identify
from tests.llm.test_exact_dedup import plain as plain_groups
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain as plain_removal

WORDS = "the of and a to in is on by it or be at as for was with that this from".split()


def corpus():
    import random

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed"]) for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randint(5, 200)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"{text(40)} {passage} {text(30)}", "en", "s", 0) for i in range(4)]
    rows += [(200, rows[3][1], "en", "s", 0), (201, rows[3][1] + "  ", None, None, 0), (202, None, "en", "s", 0), (203, "123 456", "en", "s", 0)]
    long = text(400)
    rows += [(204, long, "en", "s", 0), (205, long + " more", "en", "s", 0), (206, text(3000), "en", "s", 0)]
    return rows


def test_stages_match_plain_forms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs_before = docs = corpus_pipeline.stage(docs, "before")
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = function(spark, docs, "")
        assert after.columns == docs.columns
        docs = corpus_pipeline.stage(after, name)
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            told = {r.doc_id for r in identify(docs_before).filter("lang_pred <> 'und' and score >= 0.5").collect()}
            assert got == sorted((i, t) for i, t in before if i in told) and not {202, 203} & told and len(told) > 60
        elif name == "exact_dedup":
            keep = {i for i, _, _, kept in [(r[0], *r[1:]) for r in plain_groups(before)] if kept}
            assert got == sorted((i, t) for i, t in before if i in keep)
        elif name == "simhash_dedup":
            groups = defaultdict(list)
            for (i, _), c in zip(before, plain_components([plain_fingerprint(t) for _, t in before])):
                groups[c].append(i)
            assert [i for i, _ in got] == sorted(min(g) for g in groups.values())
        else:
            want = plain_removal([t for _, t in before])
            assert got == sorted((i, w[3].decode(errors="ignore")) for (i, _), w in zip(before, want))
            assert any(w[1] for w in want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_run_over_the_table(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in rows)


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    rows = [(k, f"the words of document number {k} and some more of them here", "en", k, "x", k * 0.5, "mine") for k in range(12)] + [(3, "the words of document number 3 and some more of them here", "en", 3, "x", 1.5, "mine"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __row long, lang_pred string, score double, doc string")
    before = {r.doc_id: r for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, "")
        assert after.columns == docs.columns and after.schema == docs.schema, name
        assert all(before[r.doc_id] == r for r in after.collect()), name
        assert function(spark, docs.limit(0), "").count() == 0, name
    name, function = corpus_pipeline.STAGES[-1]
    assert function(spark, docs, "").count() == len(rows) and function(spark, docs.limit(0), "").count() == 0


def test_intermediate_tables_go(spark, sf_dir):
    from buildproof.llm.common import staged_now

    before = staged_now()
    corpus_pipeline.run(spark, sf_dir).count()
    assert not {p for p in staged_now() - before if "language_id" in p or "exact_dedup" in p or "fingerprints" in p}
