"""Uploads and processing as changes of the tables of files and jobs.

Tables are values: a flow takes the tables as they stand and gives the rows to add or change, so that a caller appends or
upserts them. Nothing is collected. Cases: nulls in ids or names are refused with a reason like any other fault; several requests for one file in one call count as
one; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions import urls as U
from fathomline.operators import jobs as J
from fathomline.sources.sinks import stable_id

FILE_COLUMNS = ("id", "tenant_id", "file_path", "file_name", "file_size", "file_type", "file_hash", "created_at", "updated_at", "processing_status")


def request_upload(requests: DataFrame, now: Column) -> DataFrame:
    """(request_id, tenant_id, file_name, error, file): for each request (request_id, tenant_id, file_name, file_type) the pending file it makes.

    A name that isn't safe, or a missing tenant, is refused: error says so and file is null. The file has neither size nor
    hash, as its bytes come later; its path is the key under which the object store will hold it.
    """
    safe = U.is_safe_name(F.col("file_name"))
    error = F.when(~safe, F.lit("invalid_file_name")).when(F.col("tenant_id").isNull() | F.col("request_id").isNull(), F.lit("invalid_request"))
    key = stable_id(F.col("tenant_id"), F.col("request_id"))
    none = lambda t: F.lit(None).cast(t)
    made = F.struct(key.alias("id"), "tenant_id", U.storage_key(F.col("tenant_id"), key).alias("file_path"), "file_name", none("bigint").alias("file_size"), "file_type", none("string").alias("file_hash"), now.alias("created_at"), now.alias("updated_at"), F.lit("pending").alias("processing_status"))
    return requests.withColumn("error", error).select("request_id", "tenant_id", "file_name", "error", F.when(F.col("error").isNull(), made).alias("file"))


def complete_upload(files: DataFrame, jobs: DataFrame, uploads: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What becomes of uploads (file_id) that are said to be complete, and the jobs to add.

    The first table has (file_id, outcome): 'queued'; 'missing' if there is no such file; 'already_queued' if a job for it
    is active. Whether the bytes are there isn't looked up.
    """
    asked = uploads.where(F.col("file_id").isNotNull()).select("file_id").distinct()
    known = files.select(F.col("id").alias("file_id"), F.col("tenant_id")).dropDuplicates(["file_id"]).withColumn("_known", F.lit(True))
    busy = J.active(jobs).select("file_id").distinct().withColumn("_busy", F.lit(True))
    both = asked.join(known, "file_id", "left").join(busy, "file_id", "left")
    outcome = F.when(F.col("_known").isNull(), "missing").when(F.col("_busy"), "already_queued").otherwise("queued")
    told = both.select("file_id", "tenant_id", outcome.alias("outcome"))
    return told.select("file_id", "outcome"), job_rows(told.where("outcome = 'queued'"), "file_processing", now)


def job_rows(files: DataFrame, kind: str, now: Column) -> DataFrame:
    """A pending job for each of files (file_id, tenant_id). The same call again makes the same ids."""
    key = stable_id(F.lit("job"), F.lit(kind), F.col("file_id"), now)
    return files.select(key.alias("id"), "tenant_id", "file_id", F.lit(kind).alias("job_type"), F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), now.alias("created_at"))


def upload_with_processing(files: DataFrame, uploads: DataFrame, jobs: DataFrame, now: Column, queue_is_up: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outcome of uploads (request_id, tenant_id, file_name, file_type, file_size, file_hash, process), files and jobs to add.

    Content that the tenant holds already, by its hash, is 'duplicate' and adds nothing. An upload whose job can't be queued
    (queue_is_up is false) still succeeds, as 'uploaded'; with a job it is 'queued'.
    """
    asked = request_upload(uploads, now).select("request_id", "error", "file").join(uploads.select("request_id", "file_size", "file_hash", "process").dropDuplicates(["request_id"]), "request_id")
    held = files.where(F.col("file_hash").isNotNull()).select("tenant_id", "file_hash").distinct().withColumn("_held", F.lit(True))
    asked = asked.withColumn("tenant_id", F.col("file.tenant_id"))
    first = F.row_number().over(Window.partitionBy("tenant_id", "file_hash").orderBy("request_id")) > 1
    both = asked.join(held, ["tenant_id", "file_hash"], "left").withColumn("_again", F.col("file_hash").isNotNull() & F.col("tenant_id").isNotNull() & first)
    queued = F.coalesce("process", F.lit(False)) & (F.lit(True) if queue_is_up is None else queue_is_up)
    outcome = F.coalesce("error", F.when(F.col("_held") | F.col("_again"), F.lit("duplicate")).when(queued, F.lit("queued")).otherwise(F.lit("uploaded")))
    told = both.withColumn("outcome", outcome)
    kept = told.where(F.col("outcome").isin("queued", "uploaded"))
    new = kept.select(*(F.col(c) if c in ("file_size", "file_hash") else F.col(f"file.{c}") for c in FILE_COLUMNS))
    made = job_rows(kept.where("outcome = 'queued'").select(F.col("file.id").alias("file_id"), "tenant_id"), "file_processing", now)
    return told.select("request_id", "outcome", F.when(F.col("outcome").isin("queued", "uploaded"), F.col("file.id")).alias("file_id")), new, made


def process(files: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What becomes of files whose processing gave results (file_id, error), and the files after it.

    The first table has (file_id, outcome, message): 'completed', 'failed' with the message, 'not_processable' for files that
    aren't pending, 'missing'. Of several results for a file an error counts before a success.
    """
    one = results.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min("error").alias("error"))
    state = files.select(F.col("id").alias("file_id"), S.normal(F.col("processing_status")).alias("state")).dropDuplicates(["file_id"]).withColumn("_known", F.lit(True))
    outcome = F.when(F.col("_known").isNull(), "missing").when(~F.coalesce(F.col("state") == "pending", F.lit(False)), "not_processable").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    told = one.join(state, "file_id", "left").select("file_id", outcome.alias("outcome"), F.col("error").alias("message"))
    change = told.where(F.col("outcome").isin("completed", "failed")).select(F.col("file_id").alias("id"), F.when(F.col("outcome") == "failed", F.concat(F.lit("failed: "), "message")).otherwise(F.lit("completed")).alias("_state"))
    after = files.join(change, "id", "left")
    new = {"processing_status": F.coalesce("_state", "processing_status"), "updated_at": F.when(F.col("_state").isNotNull(), now).otherwise(F.col("updated_at"))}
    return told.select("file_id", "outcome", F.when(F.col("outcome") == "failed", F.col("message")).alias("message")), after.select(*(new.get(c, F.col(c)).alias(c) for c in files.columns))
