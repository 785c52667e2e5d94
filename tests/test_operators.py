"""Retrieval, changes, jobs and streams on small tables."""

from __future__ import annotations

import itertools
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import vectors as V
from fathomline.operators import embedding as E
from fathomline.operators import jobs as J
from fathomline.operators import relational as R
from fathomline.operators import retrieval as Q
from fathomline.sources.sinks import stable_id


def emb(spark, rows):
    return spark.createDataFrame(rows, "id string, content_chunk_id string, embedding array<float>, extra int")


@pytest.fixture(scope="module")
def vectors(spark):
    nan = float("nan")
    return emb(spark, [("a", "c1", [1.0, 0.0], 1), ("b", "c2", [2.0, 2.0], 1), ("c", "c3", [0.0, 0.0], 1), ("d", "c4", [nan, 1.0], 1), ("e", None, [1.0, 0.0], 1), ("f", "c6", [1.0, 0.0, 0.0], 1), ("g", "c7", None, 1), ("h", "c8", [1.0, 0.0], 1), ("a", "c1", [1.0, 0.0], 1), ("i", "c9", [None, 1.0], 1), ("j", "c10", [], 1)])


def test_search_skips_unusable_vectors_and_breaks_ties_by_id(vectors):
    got = [(r["id"], round(r["similarity"], 6)) for r in Q.similarity_search(vectors, [1.0, 0.0]).collect()]
    assert got == [("a", 1.0), ("h", 1.0), ("b", 0.707107)]
    assert [r["id"] for r in Q.similarity_search(vectors, [1.0, 0.0], 10, 0.9).collect()] == ["a", "h"]


def test_limits():
    for bad in (0, 101):
        with pytest.raises(ValueError):
            Q.check_limit(bad)


def test_batch_search_equals_single_searches(spark, vectors):
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    rows = Q.batch_search(vectors.where("content_chunk_id IS NOT NULL"), asked, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [("q", "a"), ("q", "h"), ("r", "b"), ("r", "a")]


@pytest.mark.parametrize("most", [4, 5, 100])
def test_batch_search_in_blocks_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_QUERIES", most)
    x = np.random.default_rng(0).standard_normal((600, 8))
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    asked = e.where("id % 50 = 0").selectExpr("id AS query_id", "embedding AS vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, rank, int(i)) for q in range(0, 600, 50) for rank, i in enumerate(np.argsort(-(unit @ unit[q]))[:5], 1)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in Q.batch_search(e, asked, 5).collect()} == want


def test_grouping_keeps_the_order_of_hits_and_drops_orphans(spark):
    hits = spark.createDataFrame([("1", "c1", 0.9), ("2", "c2", 0.8), ("3", "c3", 0.7), ("4", "gone", 0.6)], "id string, content_chunk_id string, similarity double")
    chunks = spark.createDataFrame([("c1", "f1", 0, "x"), ("c2", "f2", 0, "y"), ("c3", "f1", 1, "z")], "id string, file_id string, chunk_index int, chunk_text string")
    files = spark.createDataFrame([("f1", "n1"), ("f2", "n2")], "id string, file_name string")
    assets = spark.createDataFrame([("p", "f1", None, "image", "image/png", 1, "l", 3)], "id string, file_id string, created_at timestamp, asset_type string, content_type string, page_number int, label string, byte_size long")
    d = Q.hydrate_and_group(hits, chunks, files, assets).orderBy("position").collect()
    assert [(r["file_id"], [m["content_chunk_id"] for m in r["matches"]]) for r in d] == [("f1", ["c1", "c3"]), ("f2", ["c2"])]
    assert len(d[0]["assets"]) == 1 and d[1]["assets"] is None


@pytest.mark.parametrize(("a", "b", "reason"), [((1.0, 0.0), (0.0, 1.0), None), ((1.0,), (0.0, 1.0), "dimension"), ((0.0, 0.0), (1.0, 1.0), "norm"), (None, (1.0,), "missing")])
def test_compatibility(spark, a, b, reason):
    df = spark.createDataFrame([(("m", None, list(a) if a else None), ("m", None, list(b)))], "a struct<model_name:string,model_version:string,embedding:array<float>>, b struct<model_name:string,model_version:string,embedding:array<float>>")
    assert df.select(V.mismatch(F.col("a"), F.col("b"))).first()[0] == reason


def test_cosine_of_a_vector_with_itself(spark):
    v = F.array(*(F.lit(x) for x in (0.1, 0.2, 0.3)))
    assert abs(spark.range(1).select(V.cosine(v, v)).first()[0] - 1) < 1e-9


def test_all_steps(spark):
    pairs = list(itertools.product(S.STATES, S.STATES))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["ok"] for r in df.select("a", "b", S.may_step(F.col("a"), F.col("b")).alias("ok")).collect()}
    assert {k for k, v in got.items() if v} == set(S.STEPS)


@pytest.mark.parametrize(("written", "state", "message"), [("Completed", "completed", None), ("failed: boom", "failed", "boom"), (" pending ", "pending", None), ("invalid_status", None, None), (None, None, None)])
def test_states(spark, written, state, message):
    c = F.lit(written).cast("string")
    assert tuple(spark.range(1).select(S.normal(c), S.message(c)).first()) == (state, message)


def test_upsert_delete_and_append(spark):
    df = spark.createDataFrame([("1", "x", "t"), ("2", "y", "t"), ("3", None, "t")], "id string, h string, tenant_id string")
    after = R.upsert(df, spark.createDataFrame([("1", None)], "id string, h string"), ["h"])
    assert {r["id"]: r["h"] for r in after.collect()} == {"1": None, "2": "y", "3": None}
    kept, n = R.delete(df, F.col("h") == "x")
    assert kept.count() == 2 and n.first()[0] == 1
    new = spark.createDataFrame([("4", "x", "t"), ("5", "z", "t"), ("6", "z", "t"), ("7", None, "t"), ("8", None, "t")], "id string, h string, tenant_id string")
    assert {r["id"] for r in R.append_new(df, new, ["tenant_id", "h"]).collect()} == {"5", "7", "8"}


def test_pages(spark):
    df = spark.createDataFrame([("1", None), ("2", datetime(2024, 1, 1)), ("3", datetime(2024, 1, 2)), ("4", datetime(2024, 1, 2))], "id string, created_at timestamp")
    assert [r["id"] for r in R.page(df, 0, 3, R.newest()).collect()] == ["1", "3", "4"]
    with pytest.raises(ValueError):
        R.file_page(df, "t", -1)
    assert R.by_ids(df, None, []).count() == 0


def test_fold(spark):
    at = lambda n: datetime(2024, 1, 1, 0, n)
    rows = [("a", 1, at(1), "start", None, None), ("a", 2, at(2), "progress", 0.5, None), ("a", 3, at(3), "complete", None, None), ("a", 4, at(4), "cancel", None, None), ("b", 1, at(1), "complete", None, None), ("b", 2, at(2), "start", None, None), ("b", 3, at(3), "fail", None, "no"), ("c", 1, at(1), "cancel", None, None), ("d", 1, None, "start", None, None), (None, 1, at(1), "start", None, None)]
    got = {r["key"]: (r["status"], r["progress"], r["error"]) for r in J.fold(spark.createDataFrame(rows, "key string, id int, at timestamp, kind string, value double, message string")).collect()}
    assert got == {"a": ("completed", 1.0, None), "b": ("failed", 0.1, "no"), "c": ("failed", 0.0, J.CANCELLED)}


def test_local_embeddings(spark):
    rows = E.embedded(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k int, chunk_text string"), E.HashProvider).orderBy("k").collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6 and not any(rows[1]["embedding"]) and rows[2]["embedding"] is None


def test_a_provider_that_answers_too_little_is_an_error(spark):
    class Short(E.HashProvider):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(Exception, match="vectors came back"):
        E.embedded(spark.createDataFrame([("a",)], "chunk_text string"), Short).collect()


def test_stable_ids(spark):
    a, b = spark.range(1).select(stable_id(F.lit("t"), F.lit(None), F.lit(1)), stable_id(F.lit("t"), F.lit(1), F.lit(None))).first()
    assert a != b and len(a) == 36
