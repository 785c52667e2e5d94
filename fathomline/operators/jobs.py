"""States of jobs and files as folds over their events, status views, guards and sweeps.

Events are folded per key in order of (time, id), with a state of a few fields however many events a key has.
Events with a null key, kind or time are left out. Steps that a state doesn't allow change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import times

START_PROGRESS, CANCELLED = 0.1, "Cancelled by user"
#: Progress after each step of the work, by type of job.
MILESTONES = {"file_processing": (0.2,), "url_extraction": (0.1, 0.3, 0.6), "youtube_extraction": (0.1, 0.3, 0.6)}

def milestones(starts: DataFrame, pause_s: int = 1) -> DataFrame:
    """Progress events (key, id, at, kind, value, message) of the jobs that start: starts has (key, at, job_type).

    Each type's MILESTONES, pause_s apart, after the start itself. Types without any give the start only.
    """
    kind = S.job_type(F.col("job_type"))
    none = F.array().cast("array<double>")
    values = F.coalesce(*(F.when(kind == k, F.array(*map(F.lit, v))) for k, v in MILESTONES.items()), none)
    steps = F.concat(F.array(F.lit(None).cast("double")), values)
    rows = starts.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "at", F.posexplode(steps).alias("n", "value"))
    return rows.select("key", F.col("n").cast("bigint").alias("id"), (F.col("at") + F.make_dt_interval(secs=F.col("n") * pause_s)).alias("at"), F.when(F.col("n") == 0, "start").otherwise("progress").alias("kind"), "value", F.lit(None).cast("string").alias("message"))


def advanced(state: list, kind: str, at: object, value: float | None, message: str | None) -> list:
    """The state [status, progress, started_at, completed_at, error, n_events] after an event. Steps that it doesn't allow change nothing but the number."""
    status, progress, started, completed, error, n = state
    if kind == "start" and status == "pending":
        status, progress, started, error = "processing", START_PROGRESS, at, None
    elif kind == "progress" and status == "processing":
        progress, error = max(0.0, min(1.0, value)) if value is not None else progress, message
    elif kind == "complete" and status == "processing":
        status, progress, completed, error = "completed", 1.0, at, None
    elif kind == "fail" and status == "processing":
        status, completed, error = "failed", at, message
    elif kind == "cancel" and status in ("pending", "processing"):
        status, completed, error = "failed", at, CANCELLED
    return [status, progress, started, completed, error, n + 1]


def first_state() -> list:
    return ["pending", 0.0, None, None, None, 0]


def fold(events: DataFrame) -> DataFrame:
    """(key, status, progress, started_at, completed_at, error, n_events) from events (key, id, at, kind, value, message).

    Events are sorted by key and time within partitions, which spills, and pass one by one: no key's events are held together.
    """
    ok = events.where(F.col("key").isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull())
    columns = ("key", "kind", "at", "value", "message")
    names = ["key", "status", "progress", "started_at", "completed_at", "error", "n_events"]
    time = pa.timestamp("us", "UTC")
    kinds = (pa.string(), pa.string(), pa.float64(), time, time, pa.string(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, first_state()
        for batch in batches:
            out = []
            for k, kind, at, value, message in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, *state))
                    key, state = k, first_state()
                state = advanced(state, kind, at, value, message)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, *state), kinds, strict=True)], names)

    rows = ok.select(F.col("key").cast("string").alias("key"), "at", "id", "kind", F.col("value").cast("double").alias("value"), "message")
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "id", "kind", "value", "message")
    return ordered.select(*columns).mapInArrow(run, "key string, status string, progress double, started_at timestamp, completed_at timestamp, error string, n_events int")


def view(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs as a status page shows them."""
    status = S.normal(F.col("status"))
    return jobs.select(
        "id",
        "file_id",
        S.job_type(F.col("job_type")).alias("job_type"),
        F.get_json_object("job_data", "$.url").alias("url"),
        status.alias("status"),
        F.round(F.col("progress").cast("double"), 4).alias("progress"),
        times.duration_ms(F.col("started_at"), F.col("completed_at"), status, now).alias("duration_ms"),
        times.eta_micros(F.col("started_at"), status, F.col("progress"), now).alias("eta_micros"),
        S.is_terminal(status).alias("is_terminal"),
        F.coalesce(S.message(F.col("status")), F.when(status == "failed", F.col("error_message"))).alias("error"),
    )


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(S.normal(F.col("status")).isin("pending", "processing"))


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (id, file_id, ...) whose file has no active job, one per file, the one with the smallest id."""
    first = requests.withColumn("_r", F.row_number().over(Window.partitionBy("file_id").orderBy("id"))).where("_r = 1").drop("_r")
    return first.join(active(jobs).select("file_id").distinct(), "file_id", "left_anti").select(*requests.columns)


def cancel(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The jobs with the active ones in ids failed as cancelled; a job that never started may be cancelled, too."""
    hit = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    change = F.coalesce("_hit", F.lit(False)) & F.coalesce(S.normal(F.col("status")).isin("pending", "processing"), F.lit(False))
    new = {"status": F.lit("failed"), "completed_at": now, "error_message": F.lit(CANCELLED)}
    return hit.select(*(F.when(change, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))


def pending_queue(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Pending jobs, oldest first, without those that were cancelled meanwhile."""
    waiting = jobs.where(S.normal(F.col("status")) == "pending").join(cancelled.select("id"), "id", "left_anti")
    return waiting.orderBy(F.asc_nulls_last("created_at"), "id")


def tally(chunks: DataFrame, embeddings: DataFrame, assets: DataFrame) -> DataFrame:
    """(file_id, chunks_created, embeddings_created, assets_created) of each file that has any."""
    n = lambda df, name: df.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    own = embeddings.select("content_chunk_id").join(chunks.select(F.col("id").alias("content_chunk_id"), "file_id"), "content_chunk_id")
    parts = [n(chunks, "chunks_created"), n(own, "embeddings_created"), n(assets, "assets_created")]
    out = parts[0].join(parts[1], "file_id", "full").join(parts[2], "file_id", "full")
    return out.select("file_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_created", "embeddings_created", "assets_created")))


def sweep(files: DataFrame, jobs: DataFrame, as_of: Column, dangling_s: int = 1800, stale_s: int = 1800) -> DataFrame:
    """(id, tenant_id, action) of the files that a janitor's run touches.

    Pending files without chunks that are older than dangling_s are swept; files that have been processing for longer than
    stale_s are requeued, their old jobs superseded. files: (id, tenant_id, status, updated_at).
    """
    known = files.withColumn("status", S.normal(F.col("status"))).where(F.col("updated_at").isNotNull())
    old = lambda s: F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(s))
    busy = active(jobs).where(F.col("file_id").isNotNull()).select(F.col("file_id").alias("id")).distinct().withColumn("busy", F.lit(True))
    both = known.join(busy, "id", "left")
    action = F.when((F.col("status") == "pending") & old(max(dangling_s, 1800)) & F.col("busy").isNull(), "swept").when((F.col("status") == "processing") & old(stale_s), "requeued")
    return both.select("id", "tenant_id", action.alias("action")).where(F.col("action").isNotNull())


def sweep_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count_if(F.col("action") == "swept").alias("swept"), F.count_if(F.col("action") == "requeued").alias("requeued"), F.lit(0).cast("bigint").alias("errors"))


def health(dependencies: DataFrame) -> DataFrame:
    """healthy if every dependency (name, is_up) is up, else degraded; unknown counts as down."""
    up = F.bool_and(F.coalesce("is_up", F.lit(False)))
    return dependencies.agg(F.when(F.coalesce(up, F.lit(True)), "healthy").otherwise("degraded").alias("status"), F.count_if(~F.coalesce("is_up", F.lit(False))).alias("n_down"))
