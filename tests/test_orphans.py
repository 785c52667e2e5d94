"""Orphan references: batch, increments, hot keys and edges."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.operators import orphans, skew
from fathomline.operators.orphans import Reference

SPEC = Reference("jobs", "file_id", "created_at", "files")
A, B, C = (x * 32 for x in "abc")


def t(day: int) -> datetime:
    return datetime(2024, 1, day)


def refs(spark, rows):
    return orphans.as_references(spark.createDataFrame(rows, "id string, file_id string, created_at timestamp, extra int"), SPEC)


def ups(spark, rows):
    return orphans.as_parents(spark.createDataFrame(rows, "id string, created_at timestamp"), "files")


def downs(spark, rows):
    return orphans.as_deleted(spark.createDataFrame(rows, "ref_table string, key_id string, deleted_at timestamp"))


def dashed(k: str) -> str:
    return f"{k[:8]}-{k[8:12]}-{k[12:16]}-{k[16:20]}-{k[20:]}"


def cases(references):
    return {r["row_id"]: (r["orphan_kind"], r["ref_month"]) for r in orphans.open_cases(references).collect()}


def kinds(store):
    return {k: v[0] for k, v in cases(store.references).items()}


@pytest.fixture
def store(spark, tmp_path):
    return orphans.OrphanStore(spark, str(tmp_path / "state"), 16)


def test_kinds_and_spellings(spark, store):
    r = refs(spark, [("1", A, t(5), 1), ("2", "{" + dashed(A).upper() + "} ", t(1), 1), ("3", B, t(5), 1), ("4", C, None, 1), ("5", "n/a", t(5), 1), ("6", None, t(5), 1), ("7", "  ", t(5), 1), ("1", A, t(5), 1), ("8", A, None, 1)])
    up, down = ups(spark, [(dashed(A), t(3))]), downs(spark, [("files", dashed(B).upper(), t(4))])
    store.advance(0, r, up, down)
    assert cases(store.references) == cases(orphans.judged([r], [up], down)) == {"2": ("late", "2024-01"), "3": ("deleted", "2024-01"), "4": ("missing", "unknown"), "5": ("missing", "2024-01")}


def test_increments_end_where_the_batch_does(spark, store):
    rows = [("1", A, t(5), 1), ("2", B, t(5), 1), ("3", C, t(5), 1)]
    store.advance(0, refs(spark, rows))
    assert kinds(store) == {"1": "missing", "2": "missing", "3": "missing"}
    store.advance(1, parents=ups(spark, [(A, t(1)), (B, t(9))]))
    assert kinds(store) == {"2": "late", "3": "missing"}
    store.advance(2, deleted=downs(spark, [("files", A, t(9))]))
    assert kinds(store) == {"1": "deleted", "2": "late", "3": "missing"}
    store.advance(3, refs(spark, [("3", B, t(10), 1)]))
    assert kinds(store) == {"1": "deleted", "2": "late"}
    store.advance(4, parents=ups(spark, [(A, t(2))]))
    assert kinds(store) == {"2": "late"}
    counts = {(r["ref_table"], r["orphan_kind"]): r["n_rows"] for r in orphans.snapshot(store.references).collect()}
    assert counts == {("jobs", "none"): 2, ("jobs", "late"): 1}


def test_empty_tables(spark, store):
    store.advance(0, refs(spark, []), ups(spark, []), downs(spark, []))
    assert cases(store.references) == {} and cases(orphans.judged([refs(spark, [])], [ups(spark, [])], downs(spark, []))) == {}


def keys(*numbers):
    return [f"{n:032x}" for n in numbers]


def test_a_delta_is_applied_once_and_the_state_is_opened_again(spark, tmp_path):
    path = str(tmp_path / "s")
    orphans.OrphanStore(spark, path, 8).advance(0, refs(spark, [("1", A, t(5), 1)]), ups(spark, []), downs(spark, []))
    again = orphans.OrphanStore(spark, path)
    assert (again.last, again.buckets) == (0, 8)
    again.advance(0, refs(spark, [("2", A, t(5), 1)]))  # as after a restart: passed over
    assert kinds(again) == {"1": "missing"}
    again.advance(1, refs(spark, [("2", A, t(5), 1)]))
    assert kinds(orphans.OrphanStore(spark, path)) == {"1": "missing", "2": "missing"}


def test_a_delta_that_fails_changes_nothing(spark, store, monkeypatch):
    store.advance(0, refs(spark, [("1", A, t(5), 1)]))
    whole = orphans.OrphanStore._write

    def fail(self, number, name, *rest):
        if name == "references":
            raise OSError("lost")
        return whole(self, number, name, *rest)

    monkeypatch.setattr(orphans.OrphanStore, "_write", fail)
    with pytest.raises(OSError):
        orphans.OrphanStore(spark, store.path).advance(1, parents=ups(spark, [(A, t(1))]))
    monkeypatch.setattr(orphans.OrphanStore, "_write", whole)
    left = orphans.OrphanStore(spark, store.path)
    assert left.last == 0 and kinds(left) == {"1": "missing"}
    left.advance(1, parents=ups(spark, [(A, t(1))]))
    assert kinds(left) == {}


def test_the_cost_of_a_delta_follows_the_delta(spark, tmp_path):
    """A delta of one key rewrites one bucket of keys and of references, whatever the state's size."""
    store = orphans.OrphanStore(spark, str(tmp_path / "s"), 64)
    all_keys = keys(*range(2000))
    store.advance(0, refs(spark, [(f"r{n}", k, t(5), 1) for n, k in enumerate(all_keys)]), ups(spark, [(k, t(1)) for k in all_keys[:1000]]))
    before = dict(store.versions)
    assert len(before) >= 180
    store.advance(1, parents=ups(spark, [(all_keys[1500], t(1))]))
    changed = {k for k, v in store.versions.items() if before.get(k) != v}
    assert {t for t, _ in changed} == {"keys", "references"} and len(changed) == 2
    assert store.references.count() == 2000 and len(kinds(store)) == 999
    store.vacuum()
    assert orphans.OrphanStore(spark, store.path).references.count() == 2000


def test_a_row_that_names_another_key_later(spark, store):
    store.advance(0, refs(spark, [("1", A, t(5), 1), ("2", "no uuid", t(5), 1)]), ups(spark, [(B, t(1))]))
    assert kinds(store) == {"1": "missing", "2": "missing"}
    store.advance(1, refs(spark, [("1", B, t(5), 1), ("2", B, t(6), 1)]))
    assert kinds(store) == {} and store.references.count() == 2
    store.advance(2, deleted=downs(spark, [("files", B, t(9))]))
    assert kinds(store) == {"1": "deleted", "2": "deleted"}


def test_hot_keys_join_like_any(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.range(600).select((F.col("id") % 3 * (F.col("id") % 50)).alias("k"), F.col("id").alias("v"), F.lit(1).alias("x"))
    left = left.unionByName(spark.createDataFrame([(None, 7, 1)], "k long, v long, x int"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = sorted(map(str, skew.left_join(left, right, ["k"]).select("k", "v", "w").collect()))
    assert got == sorted(map(str, left.join(right, "k", "left").select("k", "v", "w").collect()))
