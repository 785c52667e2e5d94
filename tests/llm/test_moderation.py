"""Moderation: spelling, windows, trees, calibration and accuracy on wordings that the trees haven't seen."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.llm import moderation as M


@pytest.fixture(scope="module")
def model(spark, small):
    return M.fit(spark.read.parquet(f"{small}/moderation_examples.parquet"))


def plain(text):
    return M.restored(M.folded(text)).replace(M._MARK, " ")


def is_case(model, *texts):
    return (model.probability(M.worst(list(texts), model)[0]) >= M.THRESHOLD).tolist()


@pytest.mark.parametrize(
    ("written", "word"),
    [("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("m o r o n", "moron"), ("worth#ess", "worthless"), ("su-human", "subhuman"), ("idiooot", "idiot"), ("аsshоlе", "asshole"), ("ti​ts", "tits"), ("w0r7hl3$$", "worthless"), ("ARSCHLOCH", "arschloch"), ("crétin", "cretin"), ("l0$er", "loser"), ("b!tch", "bitch"), ("1d10t", "idiot")],
)
def test_spellings(written, word):
    assert word in M._RUN.pattern or word in "".join(c if c.isalpha() else " " for c in plain(f"so {written}, well")).split()


@pytest.mark.parametrize("text", ["Scunthorpe and Essex are classes of cocktails", "follow-up in room 101, 9.11 of 7", "a l'eau et de l'air", ""])
def test_plain_words_stay(text):
    assert M._MARK not in M.restored(M.folded(text))


def test_long_tokens_of_signs_are_looked_up_whole():
    assert M.plain("1l1l" * 5_000) is None and M.plain("!" * 5_000 + "a") is None


def test_held_out_accuracy(model):
    assert model.held_out >= 0.94


def test_wordings_without_a_word_of_the_examples(model):
    assert is_case(model, "You are a total muppet and everybody is sick of your whining face", "I will burn your house with you inside", "Go drown yourself, nobody would notice") == [True] * 3
    assert is_case(model, "The meeting starts at nine and ends at ten.", "The house was sold in May.") == [False] * 2


def test_every_passage_is_scored(model):
    """Also one without any word of the lexicons has features of its own."""
    x, _ = M.features(["Zorbel quixat flimmen", "Trandle!!! BRIXTON OOMPH"], model.weights)
    assert len(x) == 2 and x[1][M.COLUMNS.index("exclamations")] == 3 and x[1][M.COLUMNS.index("capitals")] > x[0][M.COLUMNS.index("capitals")]


def test_scores(spark, model):
    texts = [(1, "The report is late. You are a pathetic moron."), (2, "Our guide says that insults such as idiot are removed."), (3, None), (4, ""), (5, "plain lines of a manual " * 2000 + "shut up, you stupid idiot"), (6, "The cock crowed, the ass brayed on the farm."), (1, "The report is late. You are a pathetic moron."), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(k, None, t, 1) for k, t in texts], "doc_id long, source string, text string, score int")
    got = M.scored(df, model).collect()
    assert {r["doc_id"]: r["score"] >= M.THRESHOLD for r in got if r["doc_id"]} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert len(got) == 8  # rows without an id aren't folded into one
    assert M.scored(df.limit(0), model).count() == 0


def test_windows_cover_long_passages(model):
    filler = "the record of the depot lists the parts of the pump and "
    for n in (0, 7, 100, 3000):
        assert is_case(model, filler * n + "shut up you stupid moron " + filler * 20) == [True]
        assert is_case(model, filler * (n + 20)) == [False]


def test_a_passage_longer_than_a_block(monkeypatch, model):
    text = "the record of the depot lists the parts of the pump and " * 400 + "you are a pathetic moron " + "so on " * 400
    before = is_case(model, text)
    monkeypatch.setattr(M, "CHARS", 1000)
    assert is_case(model, text) == before == [True]


@pytest.mark.parametrize(("written", "word"), [("a r s c h l o c h", "arschloch"), ("D I C K H E A D,", "dickhead"), ("m о r o n", "moron")])
def test_spaced_words_in_long_passages(model, written, word):
    words = [f"plain{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(26)]
    text = " ".join([*words, "you are a", written, *words])
    assert word in plain(text)
    assert is_case(model, f"You are a pathetic {written}") == [True]


def test_features_agree_with_brute_force():
    found = ["You are a stupid idiot, and you know it", "Plain words.", "!!!", "moron " * 30]
    x, owner = M.features(found, M.Weights())
    known = M.entries()
    for row, k in zip(x, owner, strict=True):
        words = "".join(c if c.isalpha() else " " for c in plain(found[k])).split()[: M.WINDOW]
        for at, name in enumerate(M.NAMES):
            assert row[at] == sum(known.get(w, 0) >> at & 1 for w in words)
    assert np.bincount(owner, minlength=4).tolist() == [1, 1, 0, 2]


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        M.fit(spark.createDataFrame([("a", "none"), ("b", "none"), (None, "abusive"), ("c", None)], "text string, category string"))


def test_isotonic_rises_and_pools():
    xs, ps = M.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()


def test_trees_fit():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    start, trees = M.boost(x, y)
    score = M.summed_up(start, trees, x)
    assert ((score > 0) == (y > 0)).mean() > 0.96


def test_rising_features_never_lower_a_score(model):
    rng = np.random.default_rng(1)
    low = rng.random((50, len(M.COLUMNS))).astype(np.float32) * 3
    high = low.copy()
    high[:, M.RISING] += rng.random((50, len(M.RISING))).astype(np.float32) * 3
    for t in model.trees:
        if all(f in (-1, *M.RISING) for f in t.feature) and len(t.feature) <= 3:
            assert (t.predict(high.T) >= t.predict(low.T) - 1e-9).all()


def test_only_lines_without_disguise_are_passed_over():
    rng = np.random.default_rng(4)
    pieces = ["a", "b", "idiot", "m0ron", "i.d.i.o.t", "m o r o n", "su-human", "idiooot", "$", "!", "-", " ", " ", "\n", ".", "9", "wort*less", "x_y", "#"]
    for _ in range(300):
        text = "".join(rng.choice(pieces, 12))
        whole = M._LONG.sub(M._long, M._MASKED.sub(M._masked, M._ODD.sub(M._odd, M._SPACED.sub(M._spaced, text))))
        assert M.restored(text) == "\n".join(M._LONG.sub(M._long, M._MASKED.sub(M._masked, M._ODD.sub(M._odd, M._SPACED.sub(M._spaced, x)))) for x in text.split("\n"))
        assert "\n" in text or M.restored(text) == whole
