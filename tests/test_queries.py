"""Every registered query of the core against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from fathomline.plans import registry

NAMES = [k for m in registry() for k in m.QUERIES]
QUERIES = {k: f for m in registry() for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in registry() for k, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns and rows
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([shown(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([shown(r[c]) for c in sorted(columns)]) for r in rows) == want


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
