"""Packing against whole-text encoding by the tokenizer."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing

TEXTS = [
    "", None, " \t\n", "one", "~ a~b ~", "<|endoftext|> X<|ENDOFTEXT|>y a<|startoftext|>b ~", "a b c é É K ß", "don't 'll I'M ab's", "x" * 5000, "日本語テキスト 日本",
    "end. end.. a_b ab_ x`y tea-cup ok?! \"quoted\" (paren) abć stop.́ ` no break", "A B\x00C 12 a1b2 £5", " ".join(f"word{i} again. {i}" for i in range(900)),
]


def test_pieces_are_the_ids_of_whole_texts(spark):
    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    got = sorted(tuple(r)[:5] for r in packing.pieces(docs, packing.public_tokenizer(), size=128).collect())
    want = []
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 128) for p in [ids[s : s + 128]]]
    assert got == sorted(want)


def test_encoder_forgets_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 3)
    e = packing.Encoder(packing.public_tokenizer())
    first = [e.ids(pa.array(["one two three four", "five é ~"]), 2) for _ in range(3)]
    assert all((a == first[0][0]).all() and (b == first[0][1]).all() for a, b in first)


@pytest.mark.parametrize("size", [16, 64])
def test_sequences_are_gapless_and_full(spark, size):
    texts = [" ".join(["word"] * (i * i % 97)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.createDataFrame([(None, "no id"), (5, texts[5])], "doc_id long, text string"))
    rows = packing.pack(docs, size=size).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in rows)
    assert total == sum(len(t.split()) + 1 for t in [*texts, texts[5], "no id"])
    assert total / (len(by) * size) > 0.97 and sorted(by) == list(range(len(by)))
