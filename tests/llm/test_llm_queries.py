"""The registered queries run over the smallest tables and have the stated columns."""

from __future__ import annotations

import os

import pytest

from fathomline.llm import queries

COLUMNS = {
    "p1_found": {"content_chunk_id": "string"},
    "p2_found": {"content_chunk_id": "string", "turn_no": "int", "speaker_no": "int"},
    "p3_found": {"chunk_a": "string", "chunk_b": "string"},
    "p4_found": {"content_chunk_id": "string", "line_no": "int"},
    "p6_found": {"embedding_a": "string", "embedding_b": "string"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len(rows) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(got.columns)
    rows = {tuple(r) for r in got.select(*columns).collect()}
    assert rows == set(found.fetchall()) and rows
