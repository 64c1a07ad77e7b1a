"""Encoding against the public tokenizer's own library, and the transducer against a dictionary."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encoding import BYTE_BPE_50K, _merger, encode, encode_texts
from tidemark.llm.transducer import Transducer

JSON = BYTE_BPE_50K.replace(".tiktoken", ".json")
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no tokenizer files")


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), min_size=1, max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=100, deadline=None)
def test_transducer(words, others):
    t = Transducer.compile(words)
    asked = [*words, *others]
    for word, rank in zip(asked, t.ranks(asked), strict=True):
        assert (rank >= 0) == (word in words)
        if rank >= 0:
            assert list(t.ids[t.starts[rank] : t.starts[rank + 1]]) == words[word]


def test_suffixes_are_shared(tmp_path):
    words = {a.encode() + b"ing": [1] for a in ("walk", "talk", "sing")}
    t = Transducer.compile(words)
    assert len(t.final) < sum(map(len, words)) - 6
    t.save(str(tmp_path / "t"))
    mapped = Transducer.mapped(str(tmp_path / "t"))
    assert list(mapped.ranks([b"walking", b"walk", b"", b"talking", b"singing!"])) == [2, -1, -1, 1, -1]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_library_s(spark):
    rng = random.Random(8)
    texts = ["Hello world", "", None, "<|endoftext|> is text", "naïve 東京 😀👩‍🔬", " \n\n\t x  y", "don't we'll 123,456", "a" * 5000, "x" * 20_000 + " end", "﻿BOM​", "the " * 3000, "المراقب ०१२"]
    texts += ["".join(rng.choice("abcé 1!\n東😀'st") for _ in range(rng.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "clash")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode(df, "doc_id", "text").collect()}
    want = library().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(got[i] == want[i].ids for i in range(len(texts)))
    assert got[1] == [] and got[2] == [] and got[None] == library().encode("null id").ids
    counted = {r["doc_id"]: r["n_tokens"] for r in encode(df, "doc_id", "text", lengths_only=True).collect()}
    assert all(counted[i] == len(got[i]) for i in got)
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_ids_do_not_depend_on_the_lexicon():
    merge = _merger(BYTE_BPE_50K)._encode_single_piece
    full = Transducer.compile({w: list(merge(w)) for w in (b" the", b"cat", b" sat", b"\n")})
    text = ["the cat sat on the mat\n", None, "cat the"]
    for lexicon in (full, Transducer.compile({})):
        offsets, ids = encode_texts(text, lexicon, BYTE_BPE_50K)
        assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [library().encode(t or "").ids for t in text]
