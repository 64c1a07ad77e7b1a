"""Splitting against a walk that looks at every position, and exact round trips."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.splitting import cut_texts, natural_ends, split_texts


def walk(text, limit, overlap):
    paragraph, sentence, word = natural_ends(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    out, b, step = [], 0, limit
    while (reach := b + step) < len(text):
        cut = next((q for marks in (paragraph, sentence) for q in range(reach, b + step // 2, -1) if marks[q]), None)
        cut = cut or next((q for q in range(reach, b, -1) if word[q]), reach)
        out.append(cut)
        b, step = cut, limit - overlap
    return [*out, len(text)]


def pieces_of(text, cuts, overlap):
    begins = [0, *(max(c - overlap, 0) for c in cuts[:-1])]
    return [text[a:b] for a, b in zip(begins, cuts, strict=True)]


@given(st.lists(st.text(alphabet="ab .\n\r。x😀", max_size=300), min_size=1, max_size=6).filter(all), st.integers(8, 60))
@settings(max_examples=150, deadline=None)
def test_cuts_are_those_of_the_walk(texts, limit):
    overlap = limit // 5
    cuts, broken = cut_texts(texts, limit, overlap)
    for text, own, stretches in zip(texts, cuts, broken, strict=True):
        assert list(own) == walk(text, limit, overlap)
        for end, stretch in zip(own, stretches, strict=True):
            left, right = (re.split("[ \t\n\r。！？]", t) for t in (text[:end], text[end:]))
            assert stretch == (len(left[-1]) + len(right[0]) if left[-1] and right[0] else 0)
        longest = max(map(len, re.split("[ \t\n\r。！？]", text)))
        assert (longest > limit) == (max(stretches) > limit)


@pytest.mark.parametrize("text", ["x", "x" * 1500, "x" * 1501, "x" * 9000, "word " * 3000, "a. b\n\n" * 2000, "\r\n" * 2000, " " * 4000, "。" * 5000, "x" * 1700 + " " + "é" * 4000])
def test_round_trip(text):
    (cuts,), _ = cut_texts([text])
    pieces = pieces_of(text, list(cuts), 150)
    assert all(len(p) <= 1500 for p in pieces)
    joined, end = pieces[0], len(pieces[0])
    for p, c, before in zip(pieces[1:], cuts[1:], cuts[:-1], strict=True):
        begin = max(before - 150, 0)
        assert text[begin:before] == p[: before - begin]
        joined += p[before - begin :]
        end = c
    assert joined == text and end == len(text)


def test_natural_ends_come_before_forced_ones():
    text = "One two three. " * 99 + "\n\n" + "Four five six. " * 200
    (cuts,), _ = cut_texts([text])
    assert cuts[0] == text.index("Four")
    assert all(text[c - 2 : c] == ". " for c in cuts[1:-1])


def test_table(spark):
    rng = random.Random(1)
    data = [("p1", "w " * 2000, 1, "x"), ("p1", "w " * 2000, 1, "x"), (None, "y" * 1600, 2, "x"), ("p3", "", 3, "x"), ("p4", None, 4, "x"), ("p5", "".join(rng.choice("ab ") for _ in range(40_000)), 5, "x")]
    df = spark.createDataFrame(data, "item_id string, text string, piece_no int, piece string")
    got = split_texts(df, "item_id", "text").collect()
    assert {r["item_id"] for r in got} == {"p1", None, "p5"}
    for r in got:
        text = next(t for i, t, *_ in data if i == r["item_id"])
        assert r["piece"] == text[r["begin"] : r["end"]] and r["n_chars"] == len(text)
    assert sum(r["item_id"] == "p1" for r in got) == 2 * max(r["n_pieces"] for r in got if r["item_id"] == "p1")
    assert split_texts(df.limit(0), "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "item_id", "text", 100, 50)
