"""Jobs, sweeps and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import times
from fathomline.operators import ingestion as I
from fathomline.operators import jobs as J
from fathomline.operators import relational as R
from fathomline.plans import tables as P
from fathomline.plans.tables import sql, sql_status
from fathomline.storage import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: What time-dependent operators take as the present: 2025-01-15.
AS_OF = 1736899200000000
# Unicode White_Space in DuckDB's regular expressions.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOW = "TIMESTAMPTZ '2025-01-15 00:00:00+00'"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _now():
    return F.timestamp_micros(F.lit(AS_OF))


_FOLD = sql(
    "v",
    """, l AS (SELECT key, list({'tm': tm, 'id': id, 'kind': kind, 'value': value, 'message': message} ORDER BY tm, id) AS ev FROM v WHERE kind IS NOT NULL GROUP BY key),
z AS (SELECT key, len(ev) AS n, list_reduce(list_prepend({'status': 'pending', 'progress': 0.0::DOUBLE, 'started': NULL::TIMESTAMP, 'ended': NULL::TIMESTAMP, 'error': NULL::VARCHAR, 'tm': NULL::TIMESTAMP, 'kind': '', 'value': 0.0::DOUBLE, 'message': NULL::VARCHAR},
  list_transform(ev, lambda e: {'status': '', 'progress': 0.0::DOUBLE, 'started': NULL::TIMESTAMP, 'ended': NULL::TIMESTAMP, 'error': NULL::VARCHAR, 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message})),
  lambda s, e: CASE
    WHEN e.kind = 'start' AND s.status = 'pending' THEN {'status': 'processing', 'progress': 0.1::DOUBLE, 'started': e.tm, 'ended': s.ended, 'error': NULL::VARCHAR, 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message}
    WHEN e.kind = 'progress' AND s.status = 'processing' THEN {'status': s.status, 'progress': greatest(0.0::DOUBLE, least(1.0::DOUBLE, e.value)), 'started': s.started, 'ended': s.ended, 'error': e.message, 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message}
    WHEN e.kind = 'complete' AND s.status = 'processing' THEN {'status': 'completed', 'progress': 1.0::DOUBLE, 'started': s.started, 'ended': e.tm, 'error': NULL::VARCHAR, 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message}
    WHEN e.kind = 'fail' AND s.status = 'processing' THEN {'status': 'failed', 'progress': s.progress, 'started': s.started, 'ended': e.tm, 'error': e.message, 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message}
    WHEN e.kind = 'cancel' AND s.status IN ('pending', 'processing') THEN {'status': 'failed', 'progress': s.progress, 'started': s.started, 'ended': e.tm, 'error': 'Cancelled by user', 'tm': e.tm, 'kind': e.kind, 'value': e.value, 'message': e.message}
    ELSE s END) AS s FROM l)
SELECT key, s.status AS status, round(s.progress, 6) AS progress, s.error AS error, strftime(s.started, '%Y-%m-%d %H:%M:%S') AS started, strftime(s.ended, '%Y-%m-%d %H:%M:%S') AS ended, n AS n_events FROM z""",
)


def _shown(states: DataFrame) -> DataFrame:
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return states.select("key", "status", F.round("progress", 6).alias("progress"), "error", t("started_at").alias("started"), t("completed_at").alias("ended"), F.col("n_events").cast("bigint").alias("n_events"))


@query(_FOLD)
def job_state_fold(spark: SparkSession, root: str) -> DataFrame:
    return _shown(J.fold(P.job_events(read(spark, root, "events"))))


@query(_FOLD)
def stream_job_states(spark: SparkSession, root: str) -> DataFrame:
    """The same by the stream: what is left when it has been drained."""
    from fathomline.storage import new_folder
    from fathomline.streaming import jobs as stream

    return _shown(stream.latest_states(P.job_events(stream.read_stream(spark, root, "events")), new_folder(spark, "job-states")))


@query()
def stream_ingest_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents chunked by a stream and read back."""
    from fathomline.storage import new_folder
    from fathomline.streaming import jobs as stream

    path = new_folder(spark, "ingest")
    docs = stream.read_stream(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "tenant_id", "text")
    stream.ingest(docs, path)
    return spark.read.parquet(f"{path}/chunks").select("id", "tenant_id", "file_id", "chunk_index", "token_count")


_STATUS = sql_status("status")


@query(sql("j", f""", x AS (SELECT * REPLACE ({_STATUS} AS status, progress::DOUBLE AS progress), status AS written, epoch_us(started_at) AS a, epoch_us(completed_at) AS b FROM j)
SELECT id, file_id, lower(trim(job_type)) AS job_type, CASE WHEN job_data IS NOT NULL AND json_valid(job_data) THEN json_extract_string(job_data, '$.url') END AS url, status, round(progress, 4) AS progress,
CASE WHEN a IS NOT NULL THEN CASE WHEN b IS NOT NULL THEN floor((b - a) / 1000)::BIGINT WHEN status = 'processing' THEN floor(({AS_OF} - a) / 1000)::BIGINT END END AS duration_ms,
CASE WHEN status = 'processing' AND a IS NOT NULL AND progress > 0.1 THEN ({AS_OF} + (floor(floor(({AS_OF} - a) / 1000) / progress) - floor(({AS_OF} - a) / 1000)) * 1000)::BIGINT END AS eta_micros,
status IN ('completed', 'failed') AS is_terminal,
coalesce(CASE WHEN lower(trim(written)) LIKE 'failed:%' THEN trim(regexp_replace(trim(written), '^[^:]*:', '')) END, CASE WHEN status = 'failed' THEN error_message END) AS error FROM x"""))
def job_status_view(spark: SparkSession, root: str) -> DataFrame:
    return J.view(P.jobs(spark, root), _now())


@query(sql("j", f" SELECT tenant_id, count(*) AS n FROM j WHERE {_STATUS} IN ('pending', 'processing') GROUP BY tenant_id"))
def jobs_active_by_tenant(spark: SparkSession, root: str) -> DataFrame:
    return R.counted(J.active(P.jobs(spark, root)), "tenant_id")


@query(sql("jf", f" SELECT f.id, f.id AS file_id FROM f WHERE f.status = 'pending' AND NOT EXISTS (SELECT 1 FROM j WHERE j.file_id = f.id AND {sql_status('j.status')} IN ('pending', 'processing'))"))
def enqueue_guard(spark: SparkSession, root: str) -> DataFrame:
    """Pending files for which a job may be queued."""
    f = P.files(spark, root).where("status = 'pending'").select("id", F.col("id").alias("file_id"))
    return J.enqueue(P.jobs(spark, root), f)


@query(sql("j", f", x AS (SELECT *, {_STATUS} AS s FROM j), y AS (SELECT CASE WHEN s IN ('pending', 'processing') AND lower(trim(job_type)) = 'url_extraction' THEN 'cancelled' ELSE coalesce(s, 'unknown') END AS state FROM x) SELECT state, count(*) AS n FROM y GROUP BY state"))
def cancel_pending(spark: SparkSession, root: str) -> DataFrame:
    j = P.jobs(spark, root)
    after = J.cancel(j, j.where(S.job_type(F.col("job_type")) == "url_extraction"), _now())
    state = F.when(F.col("error_message").eqNullSafe(J.CANCELLED), "cancelled").otherwise(F.coalesce(S.normal(F.col("status")), F.lit("unknown")))
    return after.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("f", f" SELECT id, tenant_id, status FROM f WHERE status IN ('pending', 'processing') AND updated_at < {_NOW} - INTERVAL 1800 SECOND"))
def janitor_stale_files(spark: SparkSession, root: str) -> DataFrame:
    return R.stale(P.files(spark, root), ["pending", "processing"], 1800, _now()).select("id", "tenant_id", "status")


@query(sql("fj", f", b AS (SELECT DISTINCT file_id FROM j WHERE {_STATUS} IN ('pending', 'processing') AND file_id IS NOT NULL), x AS (SELECT CASE WHEN f.status = 'pending' AND b.file_id IS NULL THEN 'swept' WHEN f.status = 'processing' THEN 'requeued' END AS action FROM f LEFT JOIN b ON b.file_id = f.id WHERE f.updated_at < {_NOW} - INTERVAL 1800 SECOND) SELECT count(*) FILTER (WHERE action = 'swept') AS swept, count(*) FILTER (WHERE action = 'requeued') AS requeued, 0::BIGINT AS errors FROM x"))
def janitor_summary(spark: SparkSession, root: str) -> DataFrame:
    return J.sweep_summary(J.sweep(P.files(spark, root), P.jobs(spark, root), _now()))


@query(sql("cea", ", x AS (SELECT file_id, count(*) AS n FROM c WHERE file_id IS NOT NULL GROUP BY 1), y AS (SELECT c.file_id, count(*) AS n FROM e JOIN c ON c.id = e.content_chunk_id WHERE c.file_id IS NOT NULL GROUP BY 1), z AS (SELECT file_id, count(*) AS n FROM a WHERE file_id IS NOT NULL GROUP BY 1) SELECT coalesce(x.file_id, y.file_id, z.file_id) AS file_id, coalesce(x.n, 0) AS chunks_created, coalesce(y.n, 0) AS embeddings_created, coalesce(z.n, 0) AS assets_created FROM x FULL JOIN y ON x.file_id = y.file_id FULL JOIN z ON coalesce(x.file_id, y.file_id) = z.file_id"))
def job_tally(spark: SparkSession, root: str) -> DataFrame:
    return J.tally(P.table(spark, root, "content_chunks"), P.embeddings(spark, root), P.assets(spark, root))


@query(sql("t", " SELECT CASE WHEN bool_and(coalesce(is_active, FALSE)) THEN 'healthy' ELSE 'degraded' END AS status, count(*) FILTER (WHERE NOT coalesce(is_active, FALSE)) AS n_down FROM t"))
def health_rollup(spark: SparkSession, root: str) -> DataFrame:
    return J.health(P.tenants(spark, root).select("name", F.col("is_active").alias("is_up")))


@query(sql("j", f" SELECT id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at NULLS LAST, id)::INT AS position, strftime(timezone('UTC', created_at), '%Y-%m') AS month FROM j WHERE {_STATUS} = 'pending'"))
def pending_queue(spark: SparkSession, root: str) -> DataFrame:
    """Each tenant's pending jobs in the order of their turn."""
    from pyspark.sql import Window

    j = J.active(P.jobs(spark, root)).where(S.normal(F.col("status")) == "pending")
    w = Window.partitionBy("tenant_id").orderBy(R.oldest(), "id")
    return j.select("id", F.row_number().over(w).alias("position"), F.substring(times.rfc3339(F.col("created_at")), 1, 7).alias("month"))


# Requests made of the files: every fifth has a name that isn't safe.
_REQUESTS = ", r AS (SELECT id AS request_id, tenant_id, CASE WHEN abs(file_size) % 5 = 0 THEN '../' || file_name ELSE file_name END AS file_name FROM f)"
_SAFE = f"length(regexp_replace(file_name, '{_SPACE}', '', 'g')) > 0 AND NOT contains(file_name, '/') AND NOT contains(file_name, '..')"


def _requests(spark: SparkSession, root: str) -> DataFrame:
    name = F.when(F.abs("file_size") % 5 == 0, F.concat(F.lit("../"), "file_name")).otherwise(F.col("file_name"))
    return P.files(spark, root).select(F.col("id").alias("request_id"), "tenant_id", name.alias("file_name"), "file_type", "file_size", "file_hash", (F.col("status") == "pending").alias("process"), "created_at")


@query(sql("f", f"{_REQUESTS} SELECT request_id, CASE WHEN NOT coalesce({_SAFE}, FALSE) THEN 'invalid_file_name' WHEN tenant_id IS NULL THEN 'invalid_request' END AS error, CASE WHEN coalesce({_SAFE}, FALSE) AND tenant_id IS NOT NULL THEN 'pending' END AS status FROM r"))
def upload_request(spark: SparkSession, root: str) -> DataFrame:
    """Requests for an upload: the pending file of each, or why there is none."""
    return I.request_upload(_requests(spark, root), _now()).select("request_id", "error", F.col("file.processing_status").alias("status"))


@query(sql("fj", f", u AS (SELECT id AS file_id FROM f WHERE status = 'pending' UNION SELECT file_id FROM j WHERE file_id IS NOT NULL), b AS (SELECT DISTINCT file_id FROM j WHERE {_STATUS} IN ('pending', 'processing')) SELECT u.file_id, CASE WHEN f.id IS NULL THEN 'missing' WHEN b.file_id IS NOT NULL THEN 'already_queued' ELSE 'queued' END AS outcome FROM u LEFT JOIN (SELECT DISTINCT id FROM f) f ON f.id = u.file_id LEFT JOIN b ON b.file_id = u.file_id"))
def upload_complete(spark: SparkSession, root: str) -> DataFrame:
    """Uploads said to be complete, of pending files and of the files that jobs name."""
    f, j = P.files(spark, root), P.jobs(spark, root)
    said = f.where("status = 'pending'").select(F.col("id").alias("file_id")).unionByName(j.select("file_id"))
    return I.complete_upload(f, j, said, _now())[0]


@query(sql("f", f""", old AS (SELECT DISTINCT tenant_id, file_hash FROM f WHERE file_hash IS NOT NULL AND created_at < TIMESTAMPTZ '2024-07-01 00:00:00+00'),
r AS (SELECT id AS request_id, tenant_id, CASE WHEN abs(file_size) % 5 = 0 THEN '../' || file_name ELSE file_name END AS file_name, file_hash, status = 'pending' AS process FROM f WHERE NOT coalesce(created_at < TIMESTAMPTZ '2024-07-01 00:00:00+00', FALSE)),
x AS (SELECT r.*, CASE WHEN NOT coalesce({_SAFE}, FALSE) THEN 'invalid_file_name' WHEN r.tenant_id IS NULL THEN 'invalid_request' END AS error FROM r),
y AS (SELECT x.*, old.file_hash IS NOT NULL AS held, row_number() OVER (PARTITION BY CASE WHEN error IS NULL THEN x.tenant_id END, x.file_hash ORDER BY request_id) > 1 AND x.file_hash IS NOT NULL AND error IS NULL AS again FROM x LEFT JOIN old ON old.tenant_id = CASE WHEN error IS NULL THEN x.tenant_id END AND old.file_hash = x.file_hash)
SELECT outcome, count(*) AS n FROM (SELECT coalesce(error, CASE WHEN held OR again THEN 'duplicate' WHEN coalesce(process, FALSE) THEN 'queued' ELSE 'uploaded' END) AS outcome FROM y) GROUP BY 1"""))
def upload_with_processing(spark: SparkSession, root: str) -> DataFrame:
    """Uploads of the files of the second half of the time, where the tenant holds the first: outcomes counted."""
    f = P.files(spark, root)
    before = F.coalesce(F.col("created_at") < F.timestamp_micros(F.lit(1719792000000000)), F.lit(False))
    told, _, _ = I.upload_with_processing(f.where(before), _requests(spark, root).where(~before), P.jobs(spark, root), _now())
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(sql("fj", f""", r AS (SELECT file_id, min(CASE WHEN {sql_status('j.status')} = 'failed' THEN coalesce(error_message, 'unknown') END) AS error FROM j WHERE file_id IS NOT NULL GROUP BY 1)
SELECT r.file_id, CASE WHEN f.id IS NULL THEN 'missing' WHEN NOT coalesce(f.status = 'pending', FALSE) THEN 'not_processable' WHEN error IS NOT NULL THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN f.status = 'pending' THEN error END AS message FROM r LEFT JOIN f ON f.id = r.file_id"""))
def process_files(spark: SparkSession, root: str) -> DataFrame:
    """Files after their processing: only pending ones change."""
    j = P.jobs(spark, root)
    results = j.select("file_id", F.when(S.normal(F.col("status")) == "failed", F.coalesce("error_message", F.lit("unknown"))).alias("error"))
    return I.process(P.files(spark, root), results, _now())[0]


@query(sql("j", f", x AS (SELECT *, lower(trim(job_type)) AS k FROM j WHERE started_at IS NOT NULL) SELECT id AS key, n::BIGINT AS n_events, last FROM (SELECT id, CASE k WHEN 'file_processing' THEN 2 WHEN 'url_extraction' THEN 4 WHEN 'youtube_extraction' THEN 4 ELSE 1 END AS n, CASE k WHEN 'file_processing' THEN 0.2::DOUBLE WHEN 'url_extraction' THEN 0.6::DOUBLE WHEN 'youtube_extraction' THEN 0.6::DOUBLE END AS last FROM x)"))
def job_milestones(spark: SparkSession, root: str) -> DataFrame:
    """The progress events of each job that has started."""
    starts = P.jobs(spark, root).select(F.col("id").alias("key"), F.col("started_at").alias("at"), "job_type")
    return J.milestones(starts).groupBy("key").agg(F.count(F.lit(1)).alias("n_events"), F.max("value").alias("last"))


@query(sql("j", f", x AS (SELECT id AS key, lower(trim(job_type)) AS k FROM j WHERE {_STATUS} = 'pending') SELECT key, CASE WHEN k = 'url_extraction' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k = 'url_extraction' THEN 'no page' END AS error FROM x"))
def stream_ingest_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Pending jobs worked through by a durable queue, and their states by the fold of its events."""
    from fathomline.storage import new_folder
    from fathomline.streaming import jobs as stream

    handle = lambda df: df.select("id", F.when(S.job_type(F.col("job_type")) == "url_extraction", "no page").alias("error"))
    events = stream.work_queue(stream.read_stream(spark, root, "processing_jobs"), handle, new_folder(spark, "queue"))
    return J.fold(events).select("key", "status", "error")


@query(sql("v", ", x AS (SELECT DISTINCT key FROM v WHERE kind IS NOT NULL AND tm IS NOT NULL) SELECT key, 'status' AS event FROM x UNION ALL SELECT 'no such job', 'error'"))
def stream_watch_jobs(spark: SparkSession, root: str) -> DataFrame:
    """What watchers of all jobs, and of one that isn't there, are told by a stream of job events."""
    from fathomline.storage import new_folder
    from fathomline.streaming import jobs as stream

    events = read(spark, root, "events")
    wanted = P.job_events(events).where("kind is not null").select("key").unionByName(spark.createDataFrame([("no such job",)], "key string"))
    updates = stream.updates_of(P.job_events(stream.read_stream(spark, root, "events")), new_folder(spark, "watch"))
    return stream.watch(updates, wanted).select("key", "event").distinct()


@query(f"WITH p AS ({_FOLD}) SELECT count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'processing') AS n_processing FROM p")
def stream_active_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Active jobs after the last batch of a stream of job events."""
    from fathomline.storage import new_folder
    from fathomline.streaming import jobs as stream

    updates = stream.updates_of(P.job_events(stream.read_stream(spark, root, "events")), new_folder(spark, "active"))
    shown = stream.active_snapshots(updates)
    return shown.agg(F.max_by(F.struct("n_pending", "n_processing"), "batch").alias("r")).select("r.*")


@query(sql("f", " SELECT tenant_id || '/' || id AS key, sha256(file_name || '!') AS digest FROM f WHERE tenant_id IS NOT NULL AND file_name IS NOT NULL AND file_size % 3 <> 0"))
def object_store(spark: SparkSession, root: str) -> DataFrame:
    """Objects put, put again, and some deleted: what is left, with links that hold."""
    from fathomline.sources.sinks import ObjectStore, link, link_holds
    from fathomline.storage import new_folder

    f = P.files(spark, root).where(F.col("tenant_id").isNotNull() & F.col("file_name").isNotNull())
    store = ObjectStore(spark, new_folder(spark, "objects"))
    made = lambda c: f.select("tenant_id", "id", c.cast("binary").alias("bytes"), F.lit("text/plain").alias("content_type"))
    store.put(made(F.col("file_name")))
    store.put(made(F.concat("file_name", F.lit("!"))))
    store.delete(f.where(F.coalesce(F.col("file_size") % 3 == 0, F.lit(True))))
    until = F.timestamp_micros(F.lit(1767225600000000))
    return store.get().where(link_holds(link(F.col("key"), until, F.lit("s")), _now(), F.lit("s"))).select("key", F.sha2("bytes", 256).alias("digest"))
