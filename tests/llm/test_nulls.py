"""Nulls in every column, and extra columns with the operators' own names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fathomline.llm import boilerplate, knn, leakage, mixing, moderation, neardup, splitting, transcripts

LONG = "one two three four five six seven eight nine ten"


def clash(df, *names):
    """df with extra columns of those names, or as it is."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(1))
    return df


def test_pairs(spark):
    df = spark.createDataFrame([("a", LONG), ("b", LONG + " eleven"), (None, LONG), ("c", None), (None, None)], "id string, text string")
    df = clash(df, "class", "size", "c1", "c2", "elements", "bucket")
    assert {tuple(r) for r in neardup.pairs(df, 3, 0.5).collect()} == {("a", "b")}


def test_vectors(spark):
    rows = [("a", "x", [1.0, 0.0], "m", None), ("b", "y", [1.0, 0.1], "m", None), (None, "z", [1.0, 0.0], "m", None), ("c", "w", [1.0, 0.0], None, None), (None, None, None, None, None)]
    df = clash(spark.createDataFrame(rows, "id string, content_chunk_id string, embedding array<float>, model_name string, model_version string"), "vid", "grp", "cell", "owner", "vector", "own", "other")
    assert {tuple(r) for r in knn.pairs(df, 5, 0.9).collect()} == {("a", "b")}


def test_leaks(spark):
    d = clash(spark.createDataFrame([(1, LONG), (None, LONG), (2, None)], "doc_id long, text string"), "item_id", "score", "coverage")
    i = clash(spark.createDataFrame([(1, LONG), (None, LONG), (2, None)], "item_id long, text string"), "doc_id", "score")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect()] == [(1, 1)]


def test_pages(spark):
    df = clash(spark.createDataFrame([("a", None, "A sentence here."), (None, "h", "x."), ("b", "h", None)], "id string, host string, text string"), "own", "token", "n", "of", "line_no")
    assert {tuple(r) for r in boilerplate.main_lines(df).select("id", "line_no").collect()} == {("a", 0)}


def test_turns(spark):
    df = clash(spark.createDataFrame([("a", None, "[0.0-1.0s] words here"), (None, "f", "[0.0-1.0s] words"), ("b", "f", None)], "id string, file string, text string"), "utterances", "roster", "label")
    assert [(r["id"], r["turn_no"]) for r in transcripts.speaker_turns(df).collect()] == [("a", 0)]


def test_pieces(spark):
    c = clash(spark.createDataFrame([(1, None, 3, 0, 1, None), (None, "t", None, None, None, datetime(2024, 1, 1))], "config_id int, tenant_id string, chunk_size int, chunk_overlap int, min_chunk_size int, updated_at timestamp"), "size", "overlap")
    df = clash(spark.createDataFrame([("a", None, LONG), ("b", "t", LONG), (None, "t", LONG), ("c", "t", None)], "id string, tenant_id string, text string"), "size", "overlap", "piece_no", "start")
    assert {(r["id"], r["n_pieces"]) for r in splitting.split(df, c).collect()} == {("a", 4), ("b", 4)}


def test_mixes(spark):
    d = clash(spark.createDataFrame([(1, "s", "text"), (None, "s", "more"), (2, None, "text"), (3, "s", None)], "doc_id long, source string, text string"), "rate", "share", "tokens", "mix_name", "max_repeats")
    t = clash(spark.createDataFrame([("m", "s", 1.0, None), (None, "s", 1.0, 1), ("m", None, 1.0, 1), ("m", "s", None, 1)], "mix_name string, source string, target_share double, max_repeats int"), "rate", "tokens")
    taken, report = mixing.mixed(d, t, mixing.public_vocabulary())
    assert {(r["mix_name"], r["n_copies"]) for r in taken.collect()} == {("m", 1)} and report.count() == 1


def test_scores(spark):
    e = spark.createDataFrame([("you are a stupid moron", "abusive"), ("a plain line", "none")] * 20, "text string, category string")
    d = clash(spark.createDataFrame([(1, None, None), (None, None, "you moron"), (2, "s", "plain")], "doc_id long, source string, text string"), "score", "passage")
    assert {r["doc_id"] for r in moderation.scored(d, moderation.fit(e)).collect()} == {1, 2, None}
