import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from buildproof.llm import bpe
from buildproof.llm.bpe import codec_of, decode, encode, encode_texts, halves

PATH = public_tokenizers.path("word_bpe_49k.json")
RUNS = ["abcdefghij", ["the", "tion", "ing", "!!!!", "....", "'s", "'t", "123", "é", "日本語"], "a", "日本語中文한국어", ["!", "?", "-", "--", "'", "''s"]]
PIECES = ["a", "b", "'s", "'", "!", "<|endoftext|>", "<|", "|>", "é", " ", "\n", "3", "Σ", "İ", "🙂", "the", "ing", "...", "́", "Å", "\x85", "\x1f"]


@pytest.mark.parametrize("kind", range(len(RUNS) + 1))
def test_joined_halves_match_the_library(kind):
    rng, codec = random.Random(kind), codec_of(PATH)
    for leaf in (7, 25, 60):
        for _ in range(60):
            text = "".join(rng.choice([*RUNS, PIECES][kind]) for _ in range(rng.randint(30, 400)))
            ids, joins = encode_texts(codec, [text.encode()], leaf)
            assert np.frombuffer(ids[0], "<u4").tolist() == codec.whole.encode(text, add_special_tokens=False).ids, text
            assert joins[0] == len(halves(text, leaf)) - 1 and (joins[0] > 0) == (len(text) > leaf)


def test_memory_of_chunks_is_bounded_by_bytes(monkeypatch):
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    for k in range(30):
        texts = [f"word{k}x{j} {'long' * 40}{j}".encode() for j in range(64)]
        assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode_many(texts)] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        assert codec.held < 20_000 + 64 * 300
    assert all(len(c) <= bpe.LONG_CHUNK for c in codec.memory)


def test_given_documents_are_joined_and_match_the_library():
    import pyarrow.parquet as pq

    library = Tokenizer.from_file(PATH)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    ids, joins = encode_texts(codec_of(PATH), [t.encode() for t in texts])
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(n > 0 for n in joins) > 10


def test_documents_match_the_library(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    texts = [None, "", " \n", "Hello WORLD's", "x" * 900, "ab" * 700 + " end", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ é é", "a\x1fb\xa0c", "🙂" * 300, "日本語" * 300]
    texts += ["".join(rng.choice(RUNS[1]) for _ in range(600)), "-" * 800 + "'s" + "x" * 500, "many words here " * 300]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "tie", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(docs, PATH, leaf=100, spread=1500), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "tie" if r.id is None else texts[r.id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, text[:30]
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert {r.id: r.joins for r in got}[13] == 63
    assert decode(encode(docs.limit(0), PATH), PATH).count() == 0
