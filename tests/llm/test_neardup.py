"""The near-duplicate join against brute force, and its edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex
from fractions import Fraction

from fathomline.llm import neardup as N
from fathomline.llm import wordhash as H

WORD = regex.compile(r"[\p{L}\p{N}]+")


def grams(text: str | None, n: int) -> set:
    w = WORD.findall((text or "").lower())
    return set(zip(*(w[k:] for k in range(n)), strict=False))


def brute(rows, n, t):
    sets = {i: grams(x, n) for i, x in rows}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def corpus(seed: int, n: int = 120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[at:] + w[:at]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        rows.append((f"id{k:03}", " ".join(w) or "x"))
    return rows


@pytest.mark.parametrize(("n", "t"), [(3, 0.5), (5, 0.8)])
def test_equals_brute_force(spark, n, t):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, class int")
    got = {tuple(r) for r in N.pairs(df, n, t).collect()}
    assert got == brute(rows, n, t)
    assert got


def test_hot_nodes_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(N, "NODE_ROWS", 8)
    rng = random.Random(1)
    base = [f"c{k}" for k in range(30)]
    rows = [(f"h{k:02}", " ".join([*base[: rng.randrange(20, 30)], f"own{k}"])) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {tuple(r) for r in N.pairs(df, 3, 0.5).collect()} == brute(rows, 3, 0.5)


def test_edges(spark):
    same = "one two three four"
    rows = [("a", same), ("b", same.upper() + "!"), ("c", None), ("d", ""), ("e", "two words"), ("f", "two words"), ("a", same), ("g", " \n\t"), ("h", "ünï cödé wörds 北京"), ("i", "ÜNÏ-CÖDÉ, WÖRDS (北京)")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {tuple(r) for r in N.pairs(df, 3, 0.5).collect()} == {("a", "b"), ("h", "i")}
    assert N.pairs(df.limit(0), 3, 0.5).count() == 0


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(f"k{k:03}", "same words in every row here") for k in range(300)] + [("z", "same words in every row there")], "id string, text string")
    who, links = N.similar_classes(df, 3, 0.5)
    assert who.select("class").distinct().count() == 2 and links.count() == 1


def test_word_hashes_follow_the_words():
    rng = random.Random(3)
    alphabet = "abcé北 .,-_\n\tÄß9²Ⅷ𝒳🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 10]
    h, counts = H.words(texts)
    words = [WORD.findall((t or "").lower()) for t in texts]
    assert list(counts) == [len(w) for w in words]
    seen: dict = {}
    for w, x in zip([y for w in words for y in w], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_blocks_alike(monkeypatch):
    text = " ".join(f"word{k}" for k in range(300_000))
    h, counts = H.words([text, "word7"])
    assert list(counts) == [300_000, 1] and h[7] == h[-1]


def test_overlap_bound():
    t = Fraction(1, 2)
    for a in range(1, 40):
        for b in range(1, 40):
            o = N.overlap(t, a, b)
            assert 2 * o >= a + b - o and (o == 0 or 2 * (o - 1) < a + b - (o - 1))


def test_gaps_round_trip():
    cells = np.unique(np.random.default_rng(0).integers(0, 100_000, 500))
    number = np.arange(1, len(cells) + 1).astype(np.uint8)
    far, n = N.gaps(cells, number)
    total = np.zeros(100_001, int)
    total[np.cumsum(np.frombuffer(far, np.uint8), dtype=np.int64)] += np.frombuffer(n, np.uint8)
    assert (total[cells] == number).all() and total.sum() == number.sum()


def test_small_tables_change_nothing(spark, monkeypatch):
    """A table that is far too small for the collection gives the same pairs, and partial tables are summed in stages."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(40)]
        texts += [(f"{k}a", " ".join(base)), (f"{k}b", " ".join([*base[:20], "new", *base[21:]])), (f"{k}c", " ".join(rng.sample(base, 40)))]
    df = spark.createDataFrame(texts, "id string, text string").repartition(11)
    want = {tuple(r) for r in N.pairs(df, 3, 0.5).collect()}
    monkeypatch.setattr(N, "MAX_BITS", 8)
    monkeypatch.setattr(N, "MERGE", 2)
    assert {tuple(r) for r in N.pairs(df, 3, 0.5).collect()} == want and len(want) >= 60


def test_counts_of_the_sketch(spark):
    df = spark.createDataFrame([("a b c d",)] * 5 + [("x y z",)], "text string").repartition(5)
    grams, single = N.sketch(df, 3, 16)
    assert sorted(grams[grams > 0].tolist()) == [1, 5, 5] and sorted(single[single > 0].tolist()) == [1, 1, 1, 5, 5, 5, 5]


def test_rarities_take_off_what_all_cells_have():
    plain = N.rarities(np.array([0, 0, 0, 1, 2, 8], np.uint8))
    assert plain.tolist() == [0, 0, 0, 0, 2, 6]
    full = N.rarities(np.array([100] * 50 + [101, 191], np.uint8))
    assert (full[:51] == 2).all() and full[51] > 10


def test_linked(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("a", base), ("b", base), ("c", base + " more"), ("d", "other words than those that stand in the others"), ("e", "")]
    got = {r["id"]: (r["n_copies"], r["n_links"]) for r in N.linked(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 2), "d": (1, 0)}
