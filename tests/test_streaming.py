"""Streams end where the batch forms do."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathomline.operators import jobs as J
from fathomline.operators import orphans
from fathomline.operators.chunking import ChunkConfig, word_chunks
from fathomline.streaming import jobs as S
from fathomline.streaming import orphans as O

EVENTS = "key string, id long, at timestamp, kind string, value double, message string"


def as_stream(spark, df, path, parts):
    """A stream of the rows in files of the given order, one file a batch."""
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


def test_states(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds = ["start", "progress", "fail", "cancel", "complete", "start"]
    rows = [(f"k{k % 7}", k, start + timedelta(minutes=k), kinds[(k * 5 + k // 7) % 6], (k % 10) / 10, None if k % 3 else f"m{k}") for k in range(90)]
    df = spark.createDataFrame(rows, EVENTS)
    parts = [df.where((F.col("id") >= a) & (F.col("id") < a + 30)) for a in (0, 30, 60)]
    want = {tuple(r) for r in J.fold(df).select("key", "status", "progress", "error", "n_events").collect()}
    got = S.latest_states(as_stream(spark, df, str(tmp_path / "in"), parts), str(tmp_path / "out")).select("key", "status", "progress", "error", "n_events").collect()
    assert {tuple(r) for r in got} == want


def test_ingest_is_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"d{k}", "t", " ".join(f"w{i}" for i in range(k * 7))) for k in range(12)] + [("n", "t", None)], "id string, tenant_id string, text string")
    config = ChunkConfig(20, 5, None, 0)
    S.ingest(as_stream(spark, df, str(tmp_path / "in"), [df.where("id < 'd5'"), df.where("id >= 'd5'")]), str(tmp_path / "out"), config)
    rows = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    want = {tuple(r) for r in word_chunks(df, config).select("id", "chunk_index", "chunk_text").collect()}
    assert {tuple(r) for r in rows.select("file_id", "chunk_index", "chunk_text").collect()} == want
    assert rows.select("id").distinct().count() == len(want)


def test_orphans_follow_the_deltas(spark, tmp_path):
    a, b = "a" * 32, "b" * 32
    d = lambda n: datetime(2024, 1, n)
    schema = "kind string, ref_table string, row_id string, target string, key string, time timestamp"
    first = spark.createDataFrame([("reference", "jobs", "1", "files", a, d(2)), ("reference", "jobs", "2", "files", b, d(2))], schema)
    second = spark.createDataFrame([("parent", None, None, "files", a, d(1)), ("parent", None, None, "files", b, d(3))], schema)
    third = spark.createDataFrame([("deleted", None, None, "files", a, d(4))], schema)
    seen: list[dict] = []
    publish = lambda s, _: seen.append({r["orphan_kind"]: r["n_rows"] for r in s.collect()})
    O.follow(as_stream(spark, first, str(tmp_path / "in"), [first]), str(tmp_path / "out"), publish)
    assert seen == [{"missing": 2}]
    # started again with the same folder, the stream goes on behind what it has done
    for k, part in ((1, second), (2, third)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
        end = O.follow(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b*")), str(tmp_path / "out"), publish)
    assert len(seen) == 3 and seen[-1] == {"deleted": 1, "late": 1}
    assert {(r["row_id"], r["orphan_kind"]) for r in orphans.open_cases(end.references).collect()} == {("1", "deleted"), ("2", "late")}
