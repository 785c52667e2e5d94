"""Uploads, processing, the queue, watchers, and the object store: outcomes and edges."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomline import storage
from fathomline.functions import urls as U
from fathomline.operators import ingestion as I
from fathomline.operators import jobs as J
from fathomline.operators import relational as R
from fathomline.operators import retrieval
from fathomline.operators.embedding import HashProvider
from fathomline.sources.formats import html
from fathomline.sources.sinks import ObjectStore, link, link_holds
from fathomline.streaming import jobs as S

NOW = datetime(2024, 1, 1)
FILES = "id string, tenant_id string, file_path string, file_name string, file_size long, file_type string, file_hash string, created_at timestamp, updated_at timestamp, processing_status string"
T = datetime(2024, 1, 1)


def files(spark, rows):
    return spark.createDataFrame([(i, "t", "p", "n", 1, "x", h, T, T, s) for i, h, s in rows], FILES)


def test_requests(spark):
    asked = spark.createDataFrame([("r1", "t", "a.txt", "x", 1), ("r2", "t", "../a", "x", 1), ("r3", "t", " ", "x", 1), ("r4", None, "b", "x", 1), (None, "t", "c", None, 1), ("r5", "t", None, None, 1)], "request_id string, tenant_id string, file_name string, file_type string, file int")
    got = {r["request_id"]: r for r in I.request_upload(asked, F.lit(NOW)).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"r1": None, "r2": "invalid_file_name", "r3": "invalid_file_name", "r4": "invalid_request", None: "invalid_request", "r5": "invalid_file_name"}
    f = got["r1"]["file"]
    assert f["processing_status"] == "pending" and f["file_size"] is None and f["file_path"] == f"t/{f['id']}"
    assert I.request_upload(asked.limit(0), F.lit(NOW)).count() == 0


def test_complete(spark):
    f = files(spark, [("a", None, "pending"), ("b", None, "pending")])
    jobs = spark.createDataFrame([("j", "b", "processing")], "id string, file_id string, status string")
    said = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "file_id string")
    told, made = I.complete_upload(f, jobs, said, F.lit(NOW))
    assert {tuple(r) for r in told.collect()} == {("a", "queued"), ("b", "already_queued"), ("c", "missing")}
    assert [(r["file_id"], r["status"]) for r in made.collect()] == [("a", "pending")]


def test_upload_with_processing(spark):
    held = files(spark, [("a", "h1", "completed")])
    asked = spark.createDataFrame([("1", "t", "n", "x", 5, "h1", True), ("2", "t", "n", "x", 5, "h2", True), ("3", "t", "n", "x", 5, "h2", True), ("4", "t", "n", "x", 5, None, False), ("5", "t", "a/b", "x", 5, "h9", True)], "request_id string, tenant_id string, file_name string, file_type string, file_size long, file_hash string, process boolean")
    jobs = spark.createDataFrame([], "id string, file_id string, status string")
    told, new, made = I.upload_with_processing(held, asked, jobs, F.lit(NOW))
    assert {r["request_id"]: r["outcome"] for r in told.collect()} == {"1": "duplicate", "2": "queued", "3": "duplicate", "4": "uploaded", "5": "invalid_file_name"}
    assert new.count() == 2 and made.count() == 1 and tuple(new.columns) == I.FILE_COLUMNS
    down, new, made = I.upload_with_processing(held, asked, jobs, F.lit(NOW), F.lit(False))  # a queue that is down fails no upload
    assert {r["request_id"]: r["outcome"] for r in down.collect()}["2"] == "uploaded" and new.count() == 2 and made.count() == 0


def test_process(spark):
    f = files(spark, [("a", None, "pending"), ("b", None, "PENDING "), ("c", None, "completed")])
    results = spark.createDataFrame([("a", None), ("b", "bad"), ("b", None), ("c", None), ("d", None), (None, "x")], "file_id string, error string")
    told, after = I.process(f, results, F.lit(NOW))
    assert {tuple(r) for r in told.collect()} == {("a", "completed", None), ("b", "failed", "bad"), ("c", "not_processable", None), ("d", "missing", None)}
    assert {r["id"]: r["processing_status"] for r in after.collect()} == {"a": "completed", "b": "failed: bad", "c": "completed"}


def test_milestones(spark):
    starts = spark.createDataFrame([("a", T, "URL_extraction "), ("b", T, "file_processing"), ("c", T, "other"), (None, T, "file_processing")], "key string, at timestamp, job_type string")
    got = {}
    for r in J.milestones(starts).orderBy("key", "id").collect():
        got.setdefault(r["key"], []).append((r["kind"], r["value"]))
    assert got == {"a": [("start", None), ("progress", 0.1), ("progress", 0.3), ("progress", 0.6)], "b": [("start", None), ("progress", 0.2)], "c": [("start", None)]}
    assert {r["key"]: (r["status"], r["progress"]) for r in J.fold(J.milestones(starts)).collect()} == {"a": ("processing", 0.6), "b": ("processing", 0.2), "c": ("processing", 0.1)}


def jobs_stream(spark, path):
    return spark.readStream.schema("id string, file_id string, job_type string, status string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


def test_the_queue_goes_on_where_it_stopped(spark, tmp_path):
    put = lambda k, rows: spark.createDataFrame(rows, "id string, file_id string, job_type string, status string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    seen = []

    def handle(df):
        seen.extend(sorted(r["id"] for r in df.collect()))
        return df.select("id", F.when(F.col("id") == "y", "broken").alias("error"))

    put(0, [("x", "f", "file_processing", "pending", T), ("y", "g", "url_extraction", "Pending", None), ("z", "h", "file_processing", "completed", T)])
    S.work_queue(jobs_stream(spark, tmp_path / "in"), handle, str(tmp_path / "out"))
    put(1, [("w", "f", "file_processing", "pending", T)])
    events = S.work_queue(jobs_stream(spark, tmp_path / "in"), handle, str(tmp_path / "out"))
    assert seen == ["x", "y", "w"]
    assert {r["key"]: (r["status"], r["error"]) for r in J.fold(events).collect()} == {"x": ("completed", None), "y": ("failed", "broken"), "w": ("completed", None)}


def test_watchers_are_told_until_the_end(spark):
    updates = spark.createDataFrame([("a", 0, "processing", 0.1, None), ("a", 1, "completed", 1.0, None), ("a", 2, "completed", 1.0, None), ("b", 0, "pending", 0.0, None), ("c", 0, "failed", 0.0, "x")], "key string, batch int, status string, progress double, error string")
    got = sorted(map(tuple, S.watch(updates, spark.createDataFrame([("a",), ("a",), ("c",), ("nobody",), (None,)], "key string")).select("key", "event", "batch", "status", "message").collect()), key=str)
    assert got == sorted([("a", "status", 0, "processing", None), ("a", "status", 1, "completed", None), ("c", "status", 0, "failed", "x"), ("nobody", "error", None, None, "not found")], key=str)


def test_snapshots_count_each_job_once(spark):
    updates = spark.createDataFrame([("a", 0, "processing"), ("b", 0, "pending"), ("a", 2, "completed"), ("b", 1, "processing"), ("c", 3, "pending")], "key string, batch int, status string")
    assert [tuple(r) for r in S.active_snapshots(updates).orderBy("batch").collect()] == [(0, 1, 1), (1, 0, 2), (2, 0, 1), (3, 1, 1)]


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "o"))
    rows = lambda *r: spark.createDataFrame(r, "tenant_id string, id string, bytes binary, content_type string")
    assert store.get().count() == 0
    store.put(rows(("t", "1", b"a", "x"), ("t", "2", b"b", "x"), ("u", "1", b"c", "x"), (None, "1", b"d", "x")))
    store.put(rows(("t", "1", b"aa", "x")))
    store.delete(spark.createDataFrame([("t", "2")], "tenant_id string, id string"))
    want = {("t/1", b"aa"), ("u/1", b"c")}
    assert {(r["key"], bytes(r["bytes"])) for r in store.get().collect()} == want
    assert [r["key"] for r in store.get("u").collect()] == ["u/1"]
    assert {(r["key"], bytes(r["bytes"])) for r in store.compact(str(tmp_path / "p")).get().collect()} == want


def test_links(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    url = link(F.lit("t/1"), at(100), F.lit("secret"))
    row = spark.range(1).select(link_holds(url, at(99), F.lit("secret")).alias("good"), link_holds(url, at(101), F.lit("secret")).alias("late"), link_holds(url, at(99), F.lit("other")).alias("forged"), link_holds(F.lit(None).cast("string"), at(1), F.lit("s")).alias("none"), link_holds(F.lit("t/1?until=9&signature=x"), at(1), F.lit("s")).alias("odd")).first()
    assert tuple(row) == (True, False, False, False, False)


def test_addresses_and_tokens(spark):
    row = spark.range(1).select(U.redacted(F.lit("postgres://u:p@host:5432/db?x=y")).alias("a"), U.redacted(F.lit("u:p no address")).alias("b"), U.redacted(F.lit(None).cast("string")).alias("c"), U.bearer(F.lit("bearer  abc ")).alias("d"), U.bearer(F.lit("Basic abc")).alias("e"), U.looks_like_video(F.lit("https://WWW.YouTube.com/x")).alias("f"), U.looks_like_video(F.lit(None).cast("string")).alias("g")).first()
    assert tuple(row) == ("host:5432/db", "hidden", None, "abc", None, True, False)


def test_lookups(spark):
    f = spark.createDataFrame([("a", "t", "AB", datetime(2024, 1, 2)), ("b", "t", "ab", datetime(2024, 1, 1)), ("c", "u", "ab", datetime(2023, 1, 1)), ("d", "t", None, T)], "id string, tenant_id string, file_hash string, created_at timestamp")
    asked = spark.createDataFrame([("Ab",), ("zz",), (None,)], "file_hash string")
    assert [tuple(r) for r in R.by_hash(f, "t", asked).collect()] == [("ab", "b")]
    e = spark.createDataFrame([("a", "t", "c", [1.0]), ("b", "t", None, [1.0]), ("c", "t", "c", None)], "id string, tenant_id string, content_chunk_id string, embedding array<float>")
    assert [R.checked_embedding(e, "t", k).first()["error"] for k in "abc"] == [None, "no chunk", "no vector"]
    assert R.checked_embedding(e, "u", "a").count() == 0
    tenants = spark.createDataFrame([("t", True), ("u", False)], "id string, is_active boolean")
    keys = spark.createDataFrame([], "key_hash string")
    new, told = R.create_keys(keys, tenants, spark.createDataFrame([("t", " n ", "pk_live_0123456789"), ("u", "n", "k2"), ("t", " ", "k3"), ("t", "m", None)], "tenant_id string, name string, raw_key string"), F.lit(NOW))
    assert [(r["name"], r["key_prefix"]) for r in told.collect()] == [("n", "pk_live_01234567")] and R.create_keys(new, tenants, spark.createDataFrame([("t", "n", "pk_live_0123456789")], "tenant_id string, name string, raw_key string"), F.lit(NOW))[0].count() == 0


def test_search_stays_in_the_tenant(spark):
    e = spark.createDataFrame([("1", "t", "c1", [1.0, 0.0]), ("2", "u", "c2", [1.0, 0.0]), ("3", None, "c3", [1.0, 0.0])], "id string, tenant_id string, content_chunk_id string, embedding array<double>")
    assert [r["id"] for r in retrieval.similarity_search(e, [1.0, 0.0], 10, None, "t").collect()] == ["1"]
    assert [r["id"] for r in retrieval.scores(e, [1.0, 0.0], 0.5, "u").collect()] == ["2"]
    assert retrieval.similarity_search(e, [1.0, 0.0], 10).count() == 3
    with pytest.raises(ValueError):
        retrieval.query_vector("  ", HashProvider())


@pytest.mark.parametrize(
    ("page", "text"),
    [("<html><head><title>x</title><body><p>Body text</p>", "Body text\n"), ("<title>t</title><p>hello", "hello\n"), ("<head><style>p {}</style><script>var a;</script><p>x", "x\n"), ("<html><head><meta charset=utf-8><title>t</title></head><body>y</body></html>", "y\n"), ("<head><title>t<p>never closed", ""), ("<html><head></head><body></body></html>", ""), ("", "")],
)
def test_heads_without_an_end(page, text):
    assert html.to_text(page) in (text, "t\n\n" + text)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
