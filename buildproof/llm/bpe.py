"""BPE encoding and decoding: long texts are encoded in halves that are joined exactly, as a tree."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, in_tasks, numbered, settled, slices

#: Texts of more characters are encoded in halves, down to this; the halves of texts of more bytes are spread over all tasks.
LEAF, SPREAD = 4096, 65_536
#: Bytes of chunks and of their ids that a worker remembers, and the longest chunk that it does.
REMEMBERED, LONG_CHUNK = 48 << 20, 64
#: Characters on either side of a join in the first window; the window doubles until both sides agree.
WINDOW = 64

#: Letters that the normaliser only puts in lower case, and a sign that is a pre-token of its own.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class Codec:
    """The ids of texts by a tokenizers file, made of what the library gives for chunks without white space.

    The pre-tokenizer of the file drops white space and its tokens never span it, so a text's ids are
    those of its chunks in order. A chunk's ids come from the library, once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for what is normalised already
        for t in (self.whole, self.plain):
            t.no_truncation()
            t.no_padding()
        self.plain.normalizer = normalizers.Sequence([])
        longest = max((len(t.content) for t in self.whole.get_added_tokens_decoder().values()), default=0)
        self.window = max(WINDOW, 2 * longest)  # no special token reaches out of the first window
        self.forget()
        self.signs = {s: np.array(self.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in ("", *".,;:!?")}
        self.is_end = np.zeros(self.whole.get_vocab_size(), bool)
        self.is_end[[i for token, i in self.whole.get_vocab().items() if token.endswith("</w>")]] = True

    def forget(self) -> None:
        self.memory: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _remember(self, where: dict, keys: list, made: list[bytes]) -> None:
        where.update(zip(keys, made))
        self.held += sum(map(len, keys)) + sum(map(len, made)) + 150 * len(keys)  # what Python needs for a pair, about

    def _learn_words(self, words: list[str]) -> None:
        """Remember the ids of lower-case words of letters. Each is one pre-token, so its last id alone ends a word."""
        for start in range(0, len(words), 256):
            part = words[start : start + 256]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                made = [raw[x:y] for x, y in zip(at, at[1:])]
            else:
                made = [np.array(self.plain.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in part]
            self._remember(self.words, part, made)

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks, remembered unless they are long. A word of plain letters, with one sign after it or none, is made of their ids."""
        texts = [m.decode() for m in missing]
        split = [_SIMPLE.fullmatch(t) if len(t) <= LONG_CHUNK else None for t in texts]
        self._learn_words(list({m[1].lower() for m in split if m}.difference(self.words)))
        rest = [k for k, m in enumerate(split) if m is None]
        made = {missing[k]: np.array(e.ids, "<u4").tobytes() for k, e in zip(rest, self.whole.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False))}
        made |= {chunk: self.words[m[1].lower()] + self.signs[m[2]] for chunk, m in zip(missing, split) if m}
        short = [c for c in missing if len(c) <= LONG_CHUNK]
        self._remember(self.memory, short, [made[c] for c in short])
        return made

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts; unknown chunks are asked for together."""
        out = []
        for start in range(0, len(texts), 64):
            chunks = [t.split() for t in texts[start : start + 64]]
            if self.held > REMEMBERED:
                self.forget()
            made = self._learn(missing) if (missing := list(set().union(*chunks).difference(self.memory))) else {}
            for c in chunks:
                try:
                    out.append(b"".join(map(self.memory.__getitem__, c)))
                except KeyError:  # a long chunk
                    out.append(b"".join([made[x] if x in made else self.memory[x] for x in c]))
        return out

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of a text and the characters that each covers, from the library alone."""
        e = self.whole.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


def halves(text: str, size: int = LEAF) -> list[str]:
    """The text in halves of halves, none of more than `size` characters. A cut may lie anywhere, in a word too."""
    if len(text) <= size:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], size) + halves(text[middle:], size)


Part = tuple[str, np.ndarray]  # text and its ids


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids two arrays share from the start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def join_parts(codec: Codec, left: Part, right: Part) -> Part:
    """The encoding of two texts put together, from theirs.

    The characters around the join are encoded again: the end of the left text, the start of the right one, and
    both as one. Ids that the left text ends with and its end alone as well lie at known characters, as do those that
    the right text starts with. Where the window gives the same token at the same characters as the left text, and
    later the same as the right text, the three are spliced: every pair of neighbouring tokens then stands in a
    valid encoding, which makes the whole one valid. Else the window grows, up to the whole texts.
    """
    (lt, li), (rt, ri), k = left, right, codec.window
    if not lt or not rt:
        return lt + rt, np.concatenate((li, ri))
    while True:
        tail, head = lt[-k:], rt[:k]
        ids, at = codec.tokens(tail + head)
        if len(tail) == len(lt) and len(head) == len(rt):
            return lt + rt, np.array(ids, "<u4")
        ends = [a for a, _ in at]
        unique = lambda j: ends.count(ends[j]) == 1  # noqa: E731  bytes of one character may share its place
        first, before, last, after = 0, 0, len(ids), len(ri)
        if len(tail) < len(lt):
            some, where = codec.tokens(tail)
            same = _alike(np.array(some[::-1], "<u4"), li[: -len(some) - 1 : -1] if len(some) < len(li) else li[::-1])
            known = {(where[j], some[j]): len(li) - (len(some) - j) for j in range(len(some) - same, len(some))}
            first = next((j for j in range(len(ids)) if (at[j], ids[j]) in known and unique(j)), None)
            before = None if first is None else known[at[first], ids[first]]
        if len(head) < len(rt):
            some, where = codec.tokens(head)
            same, shift = _alike(np.array(some, "<u4"), ri), len(tail)
            known = {((a + shift, b + shift), i): j for j, ((a, b), i) in enumerate(zip(where[:same], some))}
            last = next((j for j in range(len(ids) - 1, -1, -1) if (at[j], ids[j]) in known and unique(j)), None)
            after = None if last is None else known[at[last], ids[last]]
        if first is not None and last is not None and first <= last:
            return lt + rt, np.concatenate((li[:before], np.array(ids[first:last], "<u4"), ri[after if len(head) < len(rt) else len(ri) :]))
        k *= 2


def join_tree(codec: Codec, parts: list[Part]) -> Part:
    """Join neighbours pair by pair, level by level."""
    while len(parts) > 1:
        parts = [join_parts(codec, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(codec: Codec, texts: list[bytes], leaf: int = LEAF) -> tuple[list[bytes], list[int]]:
    """Ids of whole texts, and how many joins each took; the halves of all of them are encoded together."""
    parts = [halves(t.decode(), leaf) if len(t) > leaf else [t] for t in texts]
    flat = [p if isinstance(p, bytes) else p.encode() for some in parts for p in some]
    made, at, out = codec.encode_many(flat), 0, []
    for some in parts:
        ids = made[at : at + len(some)]
        at += len(some)
        out.append(ids[0] if len(some) == 1 else join_tree(codec, [(p, np.frombuffer(i, "<u4")) for p, i in zip(some, ids)])[1].astype("<u4").tobytes())
    return out, [len(some) - 1 for some in parts]


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """__row, id, ids (little-endian unsigned 32-bit, as binary) and joins (how many halves were joined) of every whole text; null is empty.

    Texts are encoded in halves of halves where they are read. Very long ones are dealt out: their halves are
    encoded in any task, and joined in the one that makes the document's row. Rows that repeat an id are texts
    of their own, an empty text has no ids, an empty table gives no rows, and other columns are ignored.
    """
    rows = numbered(settled(docs)).select(ROW, F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    long = F.octet_length("text") > spread
    id_type = rows.schema["id"].dataType.simpleString()
    key, names = f"{ROW} {ROW_TYPE}, id {id_type}", [ROW, "id", "ids", "joins"]

    def short(batches):
        codec = codec_of(path)
        for b in slices(batches):
            ids, joins = encode_texts(codec, b.column(2).to_pylist(), leaf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(joins, pa.int32())], names=names)

    def cut(batches):
        for b in slices(batches, 1):
            made = halves(b.column(2)[0].as_py().decode(), leaf)
            at = pa.array([0] * len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.string())], names=[ROW, "id", "piece", "text"])

    def part(batches):
        codec = codec_of(path)
        for b in slices(batches):
            ids = codec.encode_many([t.encode() for t in b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[ROW, "id", "piece", "text", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        parts = [(t, np.frombuffer(i, "<u4")) for t, i in zip(table.column("text").to_pylist(), table.column("ids").to_pylist())]
        ids = join_tree(codec_of(path), parts)[1].astype("<u4").tobytes()
        first = table.slice(0, 1)
        return pa.table([first.column(ROW), first.column("id"), pa.array([ids], pa.binary()), pa.array([len(parts) - 1], pa.int32())], names=names)

    schema = f"{key}, ids binary, joins int"
    near = in_tasks(rows.filter(~long), short, schema)
    dealt = in_tasks(rows.filter(long), cut, f"{key}, piece int, text string").repartition(ROW, "piece")
    parts = in_tasks(dealt, part, f"{key}, piece int, text string, ids binary")
    return near.unionByName(parts.groupBy(ROW).applyInArrow(whole, schema))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add decoded, the text that the library's decode() gives for the ids (a column of that name is replaced).

    Every row is decoded by itself, so repeated ids and rows are texts of their own and order plays no part; all other columns stay. No ids give an empty text, no rows none.
    """
    fields = [f for f in encoded.columns if f != "decoded"]
    encoded = encoded.select(*fields)
    at = fields.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"

    def run(batches):
        codec = codec_of(path)
        pieces = decoder_of(codec)
        for b in slices(batches):
            texts = [pieces(np.frombuffer(x, "<u4").tolist()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*fields, "decoded"])

    return in_tasks(encoded, run, schema)


def decoder_of(codec: Codec):
    """A function from ids to text. Without a decoder in the file the library puts a space between tokens."""
    if codec.whole.decoder is None:
        words = [codec.whole.id_to_token(i) for i in range(codec.whole.get_vocab_size())]
        return lambda ids: " ".join([words[i] for i in ids])
    return lambda ids: codec.whole.decode(ids, skip_special_tokens=False)
