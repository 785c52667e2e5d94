"""Text functions against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T

SAMPLES = ["", "   ", "Hello world test", "a b　c\td", "café, naïve, 北京", "x\x00y", "line one  \n\n  line two\t\n", "&amp;lt;b&gt; &quot;q&quot;", None]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(SAMPLES)], "k int, t string")


def one(rows, column):
    return [r[0] for r in rows.orderBy("k").select(column).collect()]


def test_words_are_separated_by_unicode_white_space(rows):
    got = one(rows, T.words(F.col("t")))
    assert got == [None if t is None else t.split() for t in SAMPLES]


def test_counts_and_emptiness(rows):
    assert one(rows, T.word_count(F.col("t")))[2] == 3
    assert one(rows, T.byte_length(F.col("t")))[2] == 16
    assert one(rows, T.is_empty(F.col("t"))) == [None if t is None else not t.strip() for t in SAMPLES]


def test_sanitize_and_tidy(rows):
    assert one(rows, T.sanitize(F.col("t")))[5] == "xy"
    assert one(rows, T.tidy_lines(F.col("t")))[6] == "line one\n  line two"


def test_unescape_is_ampersand_first(rows):
    assert one(rows, T.unescape_xml(F.col("t")))[7] == '<b> "q"'


@pytest.mark.parametrize(("name", "number"), [("ppt/slides/slide1.xml", 1), ("ppt/slides/slide12.xml", 12), ("ppt/slides/slide.xml", 4294967295), ("ppt/slides/slidex.xml", 4294967295)])
def test_slide_numbers(spark, name, number):
    assert spark.range(1).select(T.slide_number(F.lit(name))).first()[0] == number


@pytest.mark.parametrize(("name", "kind"), [("image1.png", "image/png"), ("photo.JPEG", "image/jpeg"), ("logo.svg", "image/svg+xml"), ("mystery.dat", "application/octet-stream"), ("none", "application/octet-stream")])
def test_media_types(spark, name, kind):
    assert spark.range(1).select(T.content_type(F.lit(name))).first()[0] == kind


def test_page_without_text(spark):
    got = spark.range(1).select(T.page_text(F.lit("  \x00 "), F.lit(3))).first()[0]
    assert got.startswith("[Page 3: No extractable text")


def test_hashes(spark):
    good = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08"
    got = spark.range(1).select(T.sha256(F.lit("test")), T.valid_hash(F.lit(good)), T.valid_hash(F.lit("g" * 64)), T.valid_hash(F.lit("abc"))).first()
    assert got[0] == good.lower() == got[1]
    assert got[2] is None and got[3] is None


def test_random_texts_have_pythons_words(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t  é,") for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert one(df, T.words(F.col("t"))) == [t.split() for t in texts]
