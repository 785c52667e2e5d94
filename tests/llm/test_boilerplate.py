"""Page bodies on pages made from templates."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fathomline.functions.keys import uuid_key
from fathomline.llm import boilerplate as B

COMMON = "the of and to with from for by over under near after before each some most".split()


def site(rng: random.Random, host: str, n: int):
    name = B.site_name(host).title()
    pages = []
    for k in range(n):
        topic = f"Zq{rng.randrange(10**6):06}x".translate(str.maketrans("0123456789", "abcdefghij")).capitalize()
        say = lambda: " ".join([*rng.sample(COMMON, 8), topic, f"r{rng.randrange(10**6)}"]).capitalize() + "."  # noqa: E731, B023
        teaser = "".join(rng.choice("bcdfgklm") for _ in range(9)).capitalize()
        lines = [("Home | Blog | Docs | About us", False), (f"We use cookies on {name}. Accept {k} of them.", False), (f"# Notes on {topic}", True), (say(), True), ("", False), (say(), True), (f"- quiet detail {topic}", True), ("Most read", False), (f"{teaser}: other thing", False), (f"The {teaser} goes on and o…", False), (say(), True), ("Follow us", False), (f"© {2000 + k} {name}. All rights reserved.", False)]
        pages.append((f"{host}/{k}", lines))
    return pages


def test_bodies(spark):
    rng = random.Random(1)
    pages = [p for h in ("www.alpha-news.example", "docs.beta.example", "gamma.example", "delta-hub.example") for p in site(rng, h, 12)]
    rows = [(i, i.split("/")[0], "\n".join(x for x, _ in lines)) for i, lines in pages]
    df = spark.createDataFrame([*rows, rows[0]], "id string, host string, text string").dropDuplicates(["id"])
    got = {(r["id"], r["line_no"]) for r in B.main_lines(df).collect()}
    want = {(i, k) for i, lines in pages for k, (x, main) in enumerate(lines) if main and x}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(got)
    text = B.main_text(df).collect()
    assert len(text) == len(pages) and not any("Follow us" in r["text"] or "cookies" in r["text"] for r in text)


def test_edges(spark):
    df = spark.createDataFrame([("a", "", ""), ("b", "", " \n\t\n"), ("c", "x.example", "One sentence only."), ("d", "", "x" * 100_000)], "id string, host string, text string")
    got = {(r["id"], r["line_no"]) for r in B.main_lines(df).collect()}
    assert ("c", 0) in got and not any(i in ("a", "b") for i, _ in got)
    assert B.main_lines(df.limit(0)).count() == 0


def test_pages_of_html_files(spark):
    files = spark.createDataFrame([("0" * 32, "TEXT/HTML; charset=utf-8", "https://u@www.a.example:80/x"), ("1" * 32, "application/xhtml+xml", "t/f"), ("2" * 32, "text/plain", "x"), ("3" * 32, None, "x"), ("0" * 32, "text/html", "https://www.a.example/x")], "id string, file_type string, file_path string")
    chunks = spark.createDataFrame([("c0", "0" * 32, "t"), ("c0", "0" * 32, "t"), ("c1", "{" + "1" * 32 + "}", "t"), ("c2", "2" * 32, "t"), ("c3", "3" * 32, "t"), ("c4", None, "t"), ("c5", "0" * 32, None)], "id string, file_id string, chunk_text string")
    assert {tuple(r) for r in B.pages(chunks, files.withColumn("text", F.lit(1)), uuid_key).select("id", "host").collect()} == {("c0", "www.a.example"), ("c1", "")}


def classes_of(pages):
    """Of a made host, its valid tokens by the definition, from all pages at once."""
    from collections import Counter, defaultdict

    seen = defaultdict(dict)
    for i, tokens, roles in pages:
        for k, n in Counter(zip(tokens, roles, strict=True)).items():
            seen[k][i] = n
    classes = defaultdict(list)
    for k, on in seen.items():
        if len(on) >= max(B.HOST_PAGES, B.HOST_SHARE * len(pages)):
            classes[frozenset(on.items())].append(k)
    return [sorted(c) for c in classes.values()]


def test_classes_agree_with_the_definition(spark):
    rng = random.Random(3)
    rows = [(i, "h.example", "\n".join(x for x, _ in lines)) for i, lines in site(rng, "h.example", 9)]
    rows += [(f"more/{k}", "h.example", "Home | Blog\nA sentence that is said again.\nShare this") for k in range(4)]
    found = B.parsed(spark.createDataFrame(rows, "id string, host string, text string")).cache()
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    got = [sorted((m["token"], m["role"]) for m in c["members"]) for r in B.equivalence_classes(B.occurrences(found), sizes).collect() for c in r["classes"]]
    want = classes_of([(r["id"], r["tokens"], r["roles"]) for r in found.collect()])
    assert sorted(got) == sorted(want) and any(len(c) > 2 for c in got)


RECUR = ("Stop the pump before you open the valve", "Ask the depot for a spare part")


def test_lines_of_the_body_that_recur_are_no_template(spark):
    """They stand on as many pages as parts of the template do, but share their vectors with nothing. With the vector out of the key of a class this fails."""
    rng = random.Random(5)
    rows, want = [], set()
    for k, (i, lines) in enumerate(site(rng, "www.omega.example", 14)):
        lines = [*lines[:5], *[(RECUR[j], True) for j in (0, 1) if k % 7 in (j, j + 1, j + 3, 6)], *lines[5:]]
        rows.append((i, "www.omega.example", "\n".join(x for x, _ in lines)))
        want |= {(B.token(x.lower())) for x, _ in lines if x in RECUR}
    found = B.parsed(spark.createDataFrame(rows, "id string, host string, text string")).cache()
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    own = set(B.valid_tokens(found, B.equivalence_classes(B.occurrences(found), sizes)).collect()[0]["own"])
    assert len(want) == 2 and not want & own
    assert {B.token(x) for x in ("home", "blog", "docs", "about us", "most read", "follow us")} <= own
    everything = B.equivalence_classes(B.occurrences(found).withColumn("vector", F.lit(1)).withColumn("n", F.lit(14)), sizes)
    assert set(B.valid_tokens(found, everything).collect()[0]["own"] if B.valid_tokens(found, everything).count() else ()) != own


def test_places():
    class_ = lambda vector, n, *members: {"vector": vector, "n": n, "members": [{"token": t, "role": 0} for t in members]}
    classes = [class_(1, 9, 10, 11, 12), class_(2, 5, 20), class_(3, 5, 30), class_(4, 4, 40, 41)]
    one = dict(B.places([10, 20, 11, 7, 8, 9, 30, 12, 40, 41], [0] * 10, classes))
    two = dict(B.places([10, 20, 11, 5, 30, 6, 4, 12, 41, 40], [0] * 10, classes))
    assert one[1] == two[1] and one[2] == two[2] != 0 and one[3] == two[3] == 0 and one[4] != two[4]
    assert dict(B.places([10, 20], [0, 0], [class_(2, 5, 20)])) == {2: 0}
