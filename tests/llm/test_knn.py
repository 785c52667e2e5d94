"""Most similar vectors against brute force: recall, bounds and edges."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.llm import knn as K

SCHEMA = "id string, content_chunk_id string, embedding array<float>, model_name string, model_version string, tag int"


def clusters(n: int, d: int = 64, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for k in range(0, n - 3, 4):
        x[k + 1 : k + 3] = x[k] + rng.standard_normal((2, d)) * 0.15
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, k, least):
    out = set()
    for i, own, v, m, ver in rows:
        found = []
        for j, other, w, m2, ver2 in rows:
            if own != other and m == m2 and ver == ver2 and len(v) == len(w):
                a, b = np.float32(v) / np.linalg.norm(v), np.float32(w) / np.linalg.norm(w)
                c = np.float32(a @ b)
                if c >= least:
                    found.append((-c, j))
        out |= {(min(i, j), max(i, j)) for _, j in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("cell", [20, 400])
def test_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(K, "CELL_ROWS", cell)
    x = clusters(400)
    rows = [(f"e{k:03}", f"{k:032x}", x[k].astype("f4").tolist(), "m", "1" if k % 7 else None) for k in range(len(x))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {tuple(r) for r in K.pairs(df, 5, 0.9).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want) > 0
    assert len(got - want) <= 0.02 * len(want)


def test_large_cells_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_MOST", 30)
    x = clusters(100, 8, 3)
    rows = [(f"e{k:03}", f"{k:032x}", x[k].astype("f4").tolist(), "m", "1") for k in range(len(x))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in K.pairs(df, 5, 0.9).collect()} == brute(rows, 5, 0.9)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("d", [64, 100])
def test_bounds_lose_nothing(least, d):
    x = clusters(300, d, 5).astype("f4")
    codes = K.Codes(x, x.mean(0))
    reached = codes.reaching(slice(0, len(x)), codes.planes(), least)
    near = x @ x.T >= least
    assert reached[near].mean() > 0.999
    assert least < 0.9 or reached.mean() < 0.1


def test_edges(spark):
    nan, v = float("nan"), [1.0, 0.0, 0.0]
    u = "0123456789abcdef0123456789abcdef"
    rows = [
        ("a", u, v), ("b", "{01234567-89AB-CDEF-0123-456789ABCDEF} ", v), ("c", "x", v), ("d", None, v), ("e", "y", None), ("f", "z", [0.0, 0.0, 0.0]), ("g", "w", [nan, 1.0, 0.0]),
        ("h", "q", [None, 1.0, 0.0]), ("i", "short", [1.0, 0.0]), ("c", "x", v), ("j", "p", []), ("k", "far", [0.0, 1.0, 0.0]), ("l", "scaled", [3.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "m", None, 1) for r in rows], SCHEMA)
    got = {tuple(r) for r in K.pairs(df, 5, 0.9).collect()}
    assert got == {("a", "c"), ("b", "c"), ("a", "l"), ("b", "l"), ("c", "l")}
    assert K.pairs(df.limit(0), 5, 0.9).count() == 0


def test_copies_of_one_vector(spark):
    rows = [(f"e{k:02}", f"{k % 13:032x}", [1.0, 2.0, 3.0], "m", "1") for k in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = K.most_similar(df, 5, 0.9).collect()
    best: dict = {}
    for r in got:
        best.setdefault(r["id"], set()).add(r["other"])
    owner = {r[0]: r[1] for r in rows}
    for i, own in owner.items():
        assert best[i] == set(sorted(j for j, o in owner.items() if o != own)[:5])


def test_a_chunk_with_many_vectors_hides_no_others(spark):
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [("s1", "hot", at(1.0)), ("s2", "b", at(1.0))]
    rows += [(f"h{k:02}", "hot", at(0.999 - k * 1e-4)) for k in range(14)] + [(f"o{k}", f"c{k}", at(0.96 - k * 1e-3)) for k in range(7)]
    df = spark.createDataFrame([(*r, "m", "1", 1) for r in rows], SCHEMA)
    got = {(r["id"], r["other"]) for r in K.most_similar(df, 5, 0.9).collect()}
    assert {o for i, o in got if i == "s1"} == {"s2", "o0", "o1", "o2", "o3"}
    assert {o for i, o in got if i == "s2"} == {"s1", "h00", "h01", "h02", "h03"}
    assert {(min(p), max(p)) for p in got} == brute([(*r, "m", "1") for r in rows], 5, 0.9)


def test_recall_with_a_third_of_the_rows_in_one_dense_group(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rng.standard_normal(64))
    noise = rng.standard_normal((2000, 64))
    dense = np.sqrt(0.95) * mean + np.sqrt(0.05) * unit(noise - (noise @ mean)[:, None] * mean)
    x = np.concatenate([dense, unit(rng.standard_normal((4000, 64)))]).astype("f4")
    df = spark.createDataFrame([(f"e{k:04}", f"{k:032x}", v.tolist(), "m", "1", 1) for k, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in K.pairs(df, 5, 0.9).collect()}
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    want = {(f"e{min(i, j):04}", f"e{max(i, j):04}") for i in range(len(x)) for j in np.argpartition(-cosine[i], 5)[:5] if cosine[i, j] >= 0.9}
    assert len(got & want) >= 0.99 * len(want) > 5000
    assert len(got - want) <= 0.01 * len(want)


@pytest.mark.parametrize("d", [64, 100])
def test_estimates_hold_their_bounds(d):
    x = clusters(400, d, 7).astype("f4")
    codes = K.Codes(x, x.mean(0))
    estimate, off = codes.bounds(slice(0, len(x)), codes.planes())
    assert (np.abs(estimate - x @ x.T) <= off + 1e-5).mean() > 0.998
    assert np.abs(estimate - x @ x.T).mean() < 0.15


@pytest.mark.parametrize("n", [600, 2400])
def test_without_a_threshold_the_bounds_prune(spark, monkeypatch, n):
    """Plain k nearest: the lower bounds' k-th largest leaves few pairs to compare, and recall holds at both sizes."""
    x = clusters(n, 64, 9).astype("f4")
    compared = []
    whole = np.einsum
    monkeypatch.setattr(K.np, "einsum", lambda s, a, b: compared.append(len(a)) or whole(s, a, b))
    found = [(q, o) for qs, os, _ in K.neighbours(x, x.mean(0), np.arange(1, n + 1), 2, 2, -1.0) for q, o in zip(qs.tolist(), os.tolist(), strict=True)]
    monkeypatch.undo()
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    want = {(i, j) for i in range(0, n, 4) for j in np.argpartition(-cosine[i], 2)[:2].tolist()}
    assert len(want & set(found)) >= 0.99 * len(want)
    assert sum(compared) < 0.8 * n * n
