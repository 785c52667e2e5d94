"""Transcripts in all their forms, labels, and what is none."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from fathomline.llm import transcripts as T


def told(text: str, roster=()) -> list[tuple[int, str]]:
    return [(speaker, words) for _, speaker, _, _, words in T.turns(T.parse(text), list(roster))]


FORMS = {
    "ranges": "[0.0-4.0s] Ann Bell: Hello there.\n[4.5-8.5s] and more, uh, words.\n[9.0-13.0s] Carl Dorn: (laughs)\n[14.0-16.0s] CARL DORN: Good day.",
    "dashes": "[0.0-4.0s] Ann Bell - Hello there.\n[4.5-8.5s] and more, uh, words.\n[9.0-13.0s] Carl Dorn - (laughs)\n[14.0-16.0s] CARL DORN - Good day.",
    "arrows": "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000\n<v Ann Bell>Hello there.\n\n00:00:02.500 --> 00:00:03.000\nand more, uh, words.\n\n00:00:04.000 --> 00:00:05.000\n<v C. Dorn>[music]\n\n00:00:06.000 --> 00:00:07.000\n<v Dorn, Carl>Good day.",
    "numbered": "1\n00:00:01,000 --> 00:00:02,000\nAnn Bell: Hello there.\n\n2\n00:00:02,500 --> 00:00:03,000\nand more, uh, words.\n\n3\n00:00:06,000 --> 00:00:07,000\nCarl Dorn: Good day.",
    "clock": "Transcript\n\n00:00:01 Ann Bell : Hello there.\n00:00:02 and more, uh, words.\n00:00:06 Carl Dorn : Good day.",
    "short": "0:01 - Ann Bell: Hello there.\n0:02 - Ann Bell (cont'd): and more, uh, words.\n0:06 - Dr. Dorn: Good day.",
    "after": "Ann Bell (0:01): Hello there.\nBell (0:02): and more, uh, words.\nCarl Dorn (0:06): Good day.",
    "alone": "Ann Bell  00:00:01\nHello there.\n\nann  bell  00:00:02\nand more, uh, words.\n\nCarl Dorn  00:00:06\nGood day.",
    "plain": "TRANSCRIPT — Some title\n\nAnn Bell: Hello there, all of you here.\n\nand more, uh, words.\n\nCarl Dorn: Good day to all of you.",
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    got = told(FORMS[form])
    assert [s for s, _ in got] == [0, 1]
    assert got[0][1].startswith("Hello there") and got[0][1].endswith("and more, words.") and got[1][1].startswith("Good day")


def test_order_by_time():
    assert [w for _, w in told("[5.0-6.0s] Guest: second one here\n[1.0-2.0s] Host: first one here")] == ["first one here", "second one here"]


def test_numbers_of_speakers():
    text = "S0: the first speaker says this\nSPEAKER_01: the second speaker says that\nspeaker 0 (cont.): uh\nSpk 1: the second goes on with it\nSpeaker 2: and a third one comes in"
    assert [s for s, _ in told(text)] == [0, 1, 2]


def test_one_speaker_without_labels():
    assert told("[0.0-1.0s] some words here\n[1.0-2.0s] Um.\n[2.0-3.0s] and more") == [(0, "some words here and more")]


def test_names():
    labels = ["Ann Bell", "BELL, Ann", "A. Bell", "AB", "Dr. Bell", "ann", "Carl Dorn"]
    assert len(set(T.resolve(labels, []).values())) == 2
    assert T.resolve(["Ann", "Dr. Bell"], []) == {"Ann": "ann", "Dr. Bell": "bell"}
    assert T.resolve(["Ann", "Dr. Bell"], ["ann bell"]) == {"Ann": "ann bell", "Dr. Bell": "ann bell"}


def test_like_sounding_names():
    assert T.phonetic("meyer") == T.phonetic("maier") and T.phonetic("bauer") != T.phonetic("dauer")
    assert T.resolve(["Dr. Maier"], ["ann meyer", "carl dorn"]) == {"Dr. Maier": "ann meyer"}
    assert T.resolve(["Lea", "Leo Dorn"], []) == {"Lea": "lea", "Leo Dorn": "leo dorn"}


def test_assignment_of_any_size():
    many = ["zoe", "yan", "xenia", "wim", "vera", "uwe", "tom"]
    roster = [f"{a} {b}" for a in many for b in ("bell", "dorn")]
    labels = [f"{a[0].upper()}. {b}" for a in many for b in ("Bell", "Dorn")]
    bell, dorn = (sorted(r for r in roster if r.endswith(x)) for x in ("bell", "dorn"))
    got = T.resolve(["Dr. Bell", *many, "Dr. Dorn"], roster)
    assert len(set(got.values())) == 9 and got["Dr. Bell"] in bell and got["Dr. Dorn"] in dorn
    assert all(got[a].startswith(f"{a} ") for a in many)
    assert T.resolve(labels, roster) == {x: next(r for r in roster if r[0] == x[0].lower() and r.endswith(x[3:].lower())) for x in labels}
    got = T.resolve(["Ann", "Dr. Bell", "A. Bell"], ["ann bell", "alice bell"])  # fewer names than labels
    assert got["Ann"] == "ann bell" and {got["Dr. Bell"], got["A. Bell"]} <= {"ann bell", "alice bell"}


def test_assignment_is_of_least_cost():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 3), (4, 4), (4, 6)):
        for _ in range(20):
            cost = rng.random((n, m)).round(1)
            got = T.assign(cost)
            assert len(set(got)) == n
            assert abs(sum(cost[range(n), got]) - min(sum(cost[range(n), p]) for p in permutations(range(m), n))) < 1e-9


@pytest.mark.parametrize(
    "text",
    [None, "", " \n ", "2024-01-01 10:00:00 host: started the job\n2024-01-01 10:00:05 host: stopped the job", "08:00  Breakfast is served in the hall.\n08:15  Doors open to all the guests.", "Librarian: With this a term is defined at length.\nBatch: Some other term is defined here, too.\nCache: A third one is defined after that.", "A title: short\n\nA page of prose that says: nothing is spoken here at all.", "Your privacy matters: we and our partners process data (22)\nHome\nBlog"],
)
def test_no_transcripts(text):
    assert T.parse(text) == []


def test_clean():
    assert T.clean("Uh, um...") == "" == T.clean("((pause))") == T.clean("[inaudible 00:06:17]") == T.clean("♪ ♪")
    assert T.clean("[music] We, uh, go (laughs) on.") == "We, go on."
    assert T.clean("Um den Satz zu lesen, ähm, und er ist nicht von hier") == "Um den Satz zu lesen, und er ist nicht von hier"


def test_over_a_table(spark):
    rows = [("a", "f", FORMS["ranges"]), ("a", "f", FORMS["ranges"]), ("b", "f", "[0.0-1.0s] Ann: hi you all\n[1.0-2.0s] Dr. Bell: and bye"), ("c", None, "no transcript"), ("d", None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, file string, text string, label int")
    got = {(r["id"], r["turn_no"], r["speaker_no"]) for r in T.speaker_turns(df).collect()}
    assert got == {("a", 0, 0), ("a", 1, 1), ("b", 0, 0)}
    assert T.speaker_turns(df.limit(0)).count() == 0


def test_spoken_brackets_stay():
    assert T.clean("the result (which was twelve percent) is good (laughs) (phone rings) (the whole audience laughs)") == "the result (which was twelve percent) is good"
    assert T.clean("(inaudible)") == "" == T.clean("[inaudible 00:12] ((crosstalk))")


def test_like_sounding_spellings_have_one_key():
    assert T.phonetic("david") == T.phonetic("davit") and T.phonetic("smyth") == T.phonetic("smith")
    assert T.resolve(["Smyth"], ["Jonathan Smith"]) == {"Smyth": "jonathan smith"}


def test_a_file_with_very_many_transcripts(spark, monkeypatch):
    """Hot keys of rosters are joined apart and give what plain ones do."""
    from fathomline.operators import skew

    said = "we looked at all of the numbers again today"
    rows = [(f"p{k}", "f", f"[0.0-1.0s] Lee: {said}\n[2.0-3.0s] Kim: {said}\n[4.0-5.0s] Lee: {said}") for k in range(30)]
    rows += [(f"q{k}", "f", f"[0.0-1.0s] Ada Lee: {said}\n[2.0-3.0s] Bo Kim: {said}") for k in range(30)]
    df = spark.createDataFrame(rows, "id string, file string, text string")
    plain = {tuple(r) for r in T.speaker_turns(df).select("id", "turn_no", "speaker_no", "speaker").collect()}
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    assert {tuple(r) for r in T.speaker_turns(df).select("id", "turn_no", "speaker_no", "speaker").collect()} == plain
    assert {(r[1], r[3]) for r in plain if r[0] == "p7"} == {(0, "ada lee"), (1, "bo kim"), (2, "ada lee")}
