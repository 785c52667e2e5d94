"""The index: recall, exactness with all cells, edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import ann
from fathomline.operators import retrieval as R


def vectors(n, d=32, seed=0, groups=60):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, d))
    return middle[rng.integers(0, groups, n)] + 0.5 * rng.standard_normal((n, d))


def table(spark, x):
    return spark.createDataFrame([(f"v{k:05}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<double>")


def best(x, at, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[at] @ u.T
    return {(f"v{i:05}", f"v{j:05}") for row, i in zip(s, at, strict=True) for j in np.argsort(-row, kind="stable")[:k].tolist()}


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall(spark, tmp_path, n):
    x = vectors(n)
    df = table(spark, x)
    index = ann.build(df, str(tmp_path / "index"))
    assert len(index.centroids) == n // ann.CELL_ROWS and index.vectors.count() == n
    at = np.arange(0, n, 50)
    asked = df.where(F.col("id").isin(*(f"v{k:05}" for k in at))).select(F.col("id").alias("query_id"), "vector")
    got = {(r["query_id"], r["id"]) for r in ann.search(index, asked, 5).collect()}
    want = best(x, at, 5)
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)
    exact = {(r["query_id"], r["id"]) for r in ann.search(index, asked, 5, probes=len(index.centroids)).collect()}
    assert exact == want == {(r["query_id"], r["id"]) for r in R.batch_search(df.withColumnRenamed("vector", "embedding"), asked, 5).collect()}


def test_few_cells_are_read(spark, tmp_path):
    x = vectors(3000)
    index = ann.build(table(spark, x), str(tmp_path / "index"))
    asked = table(spark, x[:1]).select(F.col("id").alias("query_id"), "vector")
    plan = ann.search(index, asked, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("cell#", "cell") or "PartitionFilters" in plan and "cell" in plan


def test_recall_on_the_test_table(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in ann.search(ann.build(e, str(tmp_path / "i")), asked, 5).collect()}
    want = {(r["query_id"], r["id"]) for r in R.batch_search(e.withColumnRenamed("vector", "embedding"), asked, 5).collect()}
    assert len(got & want) >= 0.9 * len(want) > 0


def test_edges(spark, tmp_path):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), ("h", [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, vector array<double>, cell int")
    index = ann.build(df, str(tmp_path / "i"))
    assert {r["id"] for r in index.vectors.collect()} == {"a", "b", "h"}
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), ("w", [1.0]), (None, [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r["query_id"], r["rank"], r["id"]) for r in ann.search(index, asked, 2).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    empty = ann.build(df.limit(0), str(tmp_path / "e"))
    assert ann.search(empty, asked, 2).count() == 0 and ann.search(index, asked.limit(0), 2).count() == 0
