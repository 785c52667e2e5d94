"""Leaked passages against brute force, and edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex

from fathomline.llm import leakage as L

WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute(documents, items):
    out = set()
    for i, text in items:
        w = WORD.findall((text or "").lower())
        for d, body in documents:
            b = WORD.findall((body or "").lower())
            held = {tuple(b[k : k + 8]) for k in range(len(b) - 7)}
            cover = {p for k in range(len(w) - 7) if tuple(w[k : k + 8]) in held for p in range(k, k + 8)}
            if cover and 3 * len(cover) >= len(w):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    v = [f"w{k}" for k in range(40)]
    text = lambda n: [rng.choice(v) for _ in range(n)]
    items = [(k, text(rng.randrange(5, 60))) for k in range(40)]
    documents = []
    for d in range(120):
        body = text(rng.randrange(0, 50))
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1]
            a = rng.randrange(len(w))
            body += w[a : a + rng.randrange(1, 40)] + text(rng.randrange(4))
        documents.append((d, " ".join(body)))
    items = [(k, " ".join(w[: len(w) // 2]) + "\nQ: " + " ".join(w[len(w) // 2 :])) for k, w in items]
    docs = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, item_id string")
    got = L.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(documents, items)
    assert all(0 < r["coverage"] <= 1 and 0 <= r["question_coverage"] <= 1 for r in got)


def test_items_that_repeat_a_run(spark):
    refrain = " ".join(f"r{k}" for k in range(8))
    item = " ".join(f"{refrain} " + " ".join(f"v{k}w{j}" for j in range(12)) for k in range(10))
    others = [(k, " ".join(f"o{k}w{j}" for j in range(60))) for k in range(2, 12)]
    documents = [(1, f"before {refrain} after"), (2, "none of it " * 9), (3, others[0][1])]
    items = [(1, item), *others]
    got = L.leaks(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(documents, items) == {(1, 1), (3, 2)}


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, passage.upper().replace(" ", " -- ")), (2, None), (3, ""), (4, "one two three four five six seven"), (1, passage), (5, "x " * 100_000 + passage)]
    items = [(1, passage), (2, passage), (3, None), (4, "one two three"), (1, passage)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()} == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def scores(index, terms):
    out = np.zeros(len(index.items))
    for t in terms:
        a, b = index.starts[t], index.starts[t + 1]
        out[index.item[a:b]] += index.impact[a:b]
    return out


def test_wand_finds_all_scores_from_the_threshold():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(12)], 40)) for _ in range(60)]
    index = L.build(list(range(60)), texts)
    for n in range(1, 60):
        terms = np.unique(rng.integers(0, len(index.terms), n))
        score = scores(index, terms)
        got = dict(L.wand(index, terms))
        assert set(got) == {k for k in range(60) if score[k] >= 1}
        assert all(abs(got[k] - score[k]) < 1e-9 for k in got)


def test_blocks_are_skipped():
    """Posting lists of many blocks: few items are scored, whole blocks are passed over, and nothing is lost."""
    rng = np.random.default_rng(1)
    common = " ".join(f"c{k}" for k in range(9))
    texts = [f"{common} " + " ".join(rng.choice([f"v{k}" for k in range(3000)], 20)) for _ in range(2000)]
    texts += [" ".join(f"z{j}x{k}" for k in range(10)) + f" c{j} c{j + 1} " + " ".join(f"y{j}x{k}" for k in range(60)) for j in range(8)]
    index = L.build(list(range(len(texts))), texts)
    assert np.diff(index.starts).max() > 50 * L.BLOCK
    hashes, counts = L.words(["c0 c1 c2 c3 " + " ".join(f"z3x{k}" for k in range(10)) + " c3 c4 c5"])
    at = np.searchsorted(index.terms, L.sequences(hashes, counts, 2)[0]).clip(max=len(index.terms) - 1)
    terms = np.unique(at[index.terms[at] == L.sequences(hashes, counts, 2)[0]])
    work = L.Work()
    got = dict(L.wand(index, terms, work))
    score = scores(index, terms)
    assert set(got) == {k for k in range(len(texts)) if score[k] >= 1} and 2003 in got
    assert work.skipped_blocks > 50 and work.scored < 100


def test_a_run_reaches_its_items_threshold():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], int(rng.integers(0, 40)))) for _ in range(80)]
    index = L.build(list(range(80)), texts)
    for k, t in enumerate(texts):
        w = t.split()
        for a in range(len(w) - L.RUN + 1):
            found = [x for _, terms in L.passages(index, *L.words([" ".join(["pad", *w[a : a + L.RUN], "end"])])) for x, _ in L.wand(index, terms)]
            assert k in found


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BYTES", 3)
    df = spark.createDataFrame([(1, "long text")], "item_id long, text string")
    with pytest.raises(ValueError):
        L.leaks(df.withColumnRenamed("item_id", "doc_id"), df)
