"""Mixing: shares, caps and edges."""

from __future__ import annotations

import pytest

from fathomline.llm import mixing as M


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return M.public_vocabulary()


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")


def goals(spark, rows):
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, vocabulary):
    rows = [(k, " Big Source" if k % 2 else "big-source", f"text number {k} of the large source here") for k in range(400)]
    rows += [(1000 + k, "small", f"little text {k}") for k in range(20)] + [(2000, None, "no source"), (2001, "small", None), (2002, "small", ""), (2003, "small", "little text 0"), (2004, "other", "unused")]
    taken, report = M.mixed(docs(spark, rows), goals(spark, [("m", "BIG_SOURCE", 80.0, 1), ("m", "small", 20.0, 3), ("m", "absent", 5.0, 2)]), vocabulary)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["big_source"]["actual_share"] - 80 / 100) < 0.05 and abs(r["small"]["actual_share"] - 20 / 100) < 0.05
    assert r["absent"]["actual_share"] == 0 and r["absent"]["tokens"] == 0
    got = taken.collect()
    assert max(x["n_copies"] for x in got if x["source"] == "small") <= 3
    assert sum(x["n_copies"] for x in got if x["doc_id"] in (1000, 2003)) <= 3 and not any(x["doc_id"] == 2003 for x in got)
    assert not any(x["source"] == "other" for x in got)


def test_the_draw_is_repeatable(spark, vocabulary):
    d = docs(spark, [(k, "a" if k % 3 else "b", f"text {k}") for k in range(100)])
    g = goals(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)])
    one, two = (sorted(map(str, M.mixed(d, g, vocabulary)[0].collect())) for _ in range(2))
    assert one == two


def test_without_strict_a_small_source_limits_nothing(spark, vocabulary):
    d = docs(spark, [(k, "a", f"text {k}") for k in range(100)] + [(900, "b", "text")])
    g = goals(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 2)])
    r = {x["source"]: x for x in M.mixed(d, g, vocabulary, strict=False)[1].collect()}
    assert r["a"]["n_texts"] == 100 and r["b"]["n_copies"] == 2


def test_empty(spark, vocabulary):
    d, g = docs(spark, [(1, "a", "x")]), goals(spark, [("m", "a", 1.0, 1)])
    assert M.mixed(d.limit(0), g, vocabulary)[0].count() == 0
    assert M.mixed(d, g.limit(0), vocabulary)[1].count() == 0


def test_parts_are_the_text():
    text = "word  \n" * 100_000
    assert "".join(M.parts(text)) == text and max(map(len, M.parts(text))) <= M.PART


def test_shares_against_brute_force(spark, vocabulary):
    """Rates and copies by plain Python, from the texts and the tokenizer itself."""
    from math import floor

    encode = M.tokenizer(*vocabulary).encode_ordinary
    rows = [(k, "abc"[k % 7 % 3], " ".join(f"word{k * j % 97}" for j in range(3 + k % 11))) for k in range(300)]
    goal = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 4)}
    taken, report = M.mixed(docs(spark, rows), goals(spark, [("m", s, *v) for s, v in goal.items()]), vocabulary)
    texts = {(s, t): (min(i for i, s2, t2 in rows if (s2, t2) == (s, t)), len(encode(t))) for _, s, t in rows}
    size = {s: sum(n for (s2, _), (_, n) in texts.items() if s2 == s) for s in goal}
    total = min(size[s] * cap / share for s, (share, cap) in goal.items())
    rate = {s: share * total / size[s] for s, (share, _) in goal.items()}
    got = {(r["source"], r["doc_id"]): r["n_copies"] for r in taken.collect()}
    for (s, _), (i, _) in texts.items():
        assert got.get((s, i), 0) in (floor(rate[s] + 1e-9), floor(rate[s] + 1e-9) + (rate[s] % 1 > 1e-9))
    used = {s: sum(n * got.get((s, i), 0) for (s2, _), (i, n) in texts.items() if s2 == s) for s in goal}
    for r in report.collect():
        assert abs(r["rate"] - rate[r["source"]]) < 1e-9 and r["tokens"] == used[r["source"]]
        assert abs(r["actual_share"] - used[r["source"]] / sum(used.values())) < 1e-12
        assert abs(r["actual_share"] - goal[r["source"]][0]) < 0.06
