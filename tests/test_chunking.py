"""Both chunkers against their properties and a model in Python."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.operators import chunking as C


def model(text: str, size: int, overlap: int, least: int) -> list[tuple[int, str]]:
    words, out, start = text.replace("\0", "").split(), [], 0
    while words and start < len(words):
        piece = " ".join(words[start : start + size])
        if len(piece.strip().encode()) < least:
            break
        out.append((len(out), piece))
        if start + size >= len(words):
            break
        start = max(start + size - overlap, start + 1)
    return out


@pytest.mark.parametrize(("size", "overlap", "least"), [(3, 1, 2), (5, 4, 1), (4, 0, 4), (7, 2, 0)])
def test_windows_equal_the_model(spark, size, overlap, least):
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["a", "bb", "é", "word"]) for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 33]] + ["   ", "x\0 y"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(99, None, 1)], "k int, text string, other int")
    got = C.word_chunks(df, C.ChunkConfig(size, overlap, None, least)).select("k", "chunk_index", "chunk_text").collect()
    assert {tuple(r) for r in got} == {(k, *p) for k, t in enumerate(texts) for p in model(t, size, overlap, least)}


def test_invalid_configurations_are_the_default():
    assert C.ChunkConfig(0, 0).checked() == C.ChunkConfig() == C.ChunkConfig(5, 5).checked() == C.ChunkConfig(5, 1, None, 9).checked()


def test_cap(spark):
    df = spark.createDataFrame([("a b c d e f g",)], "text string")
    assert C.word_chunks(df, C.ChunkConfig(2, 0, 2, 0)).count() == 2


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300), st.integers(1, 63))
def test_recursive_split_loses_nothing(text, most):
    parts = C.cut(text, most)
    assert "".join(parts) == text
    assert all(parts) or parts == [""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(32, 127)] + ["\n", "\t"], max_size=300), st.integers(1, 63))
def test_recursive_split_keeps_the_limit(text, most):
    assert all(len(p) <= most for p in C.cut(text, most)) or not text


@pytest.mark.parametrize("text", ["", "    ", "\n\n\n", "x" * 500, "שלום עולם", "👍🏽 北京 emoji", "a\tb\r\nc\td"])
def test_recursive_edges(text):
    assert "".join(C.cut(text, 8)) == text


def test_recursive_chunks_keep_gaps(spark):
    df = spark.createDataFrame([(1, "aaaaaaaaaaaa\n\nb\n\ncccccccccccccc"), (2, "  "), (3, None)], "k int, text string")
    got = C.recursive_chunks(df, 14, 5).orderBy("chunk_index").select("k", "chunk_index", "chunk_text").collect()
    assert [tuple(r) for r in got] == [(1, 0, "aaaaaaaaaaaa"), (1, 3, "\nccccccccccccc")]
    assert {r["k"] for r in got} == {1}
