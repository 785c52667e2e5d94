"""Splitting: round trips, limits, natural boundaries and configurations."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import splitting as S

TEXT = st.text(alphabet="ab .,;!\n\t ​\x1fé　", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 12), st.data())
def test_round_trip_and_limits(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    parts = S.pieces(text, size, overlap)
    assert "".join(text[new:end] for *_, end, new in parts) == text
    assert all(b - a <= size for a, b, *_ in parts)
    for (_, b, *_), (a2, *_) in zip(parts, parts[1:], strict=False):
        assert b - a2 == overlap
    assert (len(parts) > 1) == (S.count_words(text) > size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
def test_sparse_table(values, data):
    t = S.Strongest(np.array(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a + 1, len(values)))
    best = max(values[a:b])
    assert t.place(a, b) == max(k for k in range(a, b) if values[k] == best)


def test_cuts_are_natural():
    text = "One two three. Four five six seven, eight nine ten\n\neleven twelve thirteen fourteen."
    cut = [text[s:e].rstrip() for _, _, s, e, _ in S.pieces(text, 11, 0)]
    assert cut[0] == "One two three. Four five six seven, eight nine ten"
    cut = [text[s:e].rstrip() for _, _, s, e, _ in S.pieces(text, 5, 0)]
    assert cut[0] == "One two three." and cut[1] == "Four five six seven,"


def test_configuration_in_force(spark):
    d = lambda n: datetime(2024, 1, n)
    configs = [(1, None, 4, 1, 1, d(1)), (2, "new", 2, 0, 1, d(2)), (3, "new", 6, 0, 1, d(1)), (4, "zero", 0, 0, 0, d(1)), (5, "over", 3, 3, 1, d(1)), (6, "min", 3, 1, 9, d(1)), (7, "null", None, 1, 1, d(1)), (8, "was", 2, 0, 1, d(1)), (9, "was", 5, 9, 1, d(3))]
    chunks = [(t, t, "a b c d e") for t in ("new", "zero", "over", "min", "null", "was", "none")] + [("nobody", None, "a b c d e"), ("short", "new", "a b"), ("blank", "new", "  "), ("gone", "new", None), ("new", "new", "a b c d e")]
    c = spark.createDataFrame(configs, "config_id int, tenant_id string, chunk_size int, chunk_overlap int, min_chunk_size int, updated_at timestamp")
    rows = spark.createDataFrame([(*x, 1) for x in chunks], "id string, tenant_id string, text string, size int")
    n = {r["id"]: r["n_pieces"] for r in S.split(rows, c).where("piece_no = 0").collect()}
    assert n == {"new": 3, "zero": 2, "over": 2, "min": 2, "null": 2, "was": 2, "none": 2, "nobody": 2, "short": 1, "blank": 1}
    assert {r["id"] for r in S.split(rows, c, True).collect()} == {"new", "zero", "over", "min", "null", "was", "none", "nobody"}
    assert S.split(rows.limit(0), c).count() == 0
    assert S.split(rows, c.limit(0), True).count() == 0


def test_many_tenants_are_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_TENANTS", 0)
    c = spark.createDataFrame([(1, "t", 2, 1, 1, datetime(2024, 1, 1))], "config_id int, tenant_id string, chunk_size int, chunk_overlap int, min_chunk_size int, updated_at timestamp")
    rows = spark.createDataFrame([("x", "t", "a b c"), ("y", None, "a b c")], "id string, tenant_id string, text string")
    assert {r["id"]: r["n_pieces"] for r in S.split(rows, c).collect()} == {"x": 2, "y": 1}


def test_long_texts(spark):
    text = "word and more. " * 60_000
    parts = S.pieces(text, 500, 50)
    assert "".join(text[new:end] for *_, end, new in parts) == text


def test_memory_follows_the_window():
    table = S.Strongest(np.zeros(1_000_000, np.int64), 600)
    assert sum(x.nbytes for x in table.levels) < 45 << 20 and len(table.levels) == 10
    assert table.place(100, 700) == 699


def test_rows_that_come_again_are_split_once(spark, monkeypatch):
    text = " ".join(f"w{k}." for k in range(40))
    rows = [("a", None, text), ("a", None, text + " and more"), ("b", None, text), ("b", None, text), ("c", None, "short")]
    config = [(1, None, 10, 2, 1, None)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, text string")
    c = spark.createDataFrame(config, "config_id int, tenant_id string, chunk_size int, chunk_overlap int, min_chunk_size int, updated_at timestamp")
    for few in (S.FEW_IDS, 0):
        monkeypatch.setattr(S, "FEW_IDS", few)
        got = S.split(df, c).collect()
        for i in "abc":
            mine = sorted((r["piece_no"], r["n_pieces"]) for r in got if r["id"] == i)
            assert [k for k, _ in mine] == list(range(mine[0][1]))
