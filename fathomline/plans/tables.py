"""The tables of a query, as they stand: re-delivered rows once, states and types in their normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import status as S
from fathomline.functions.keys import dashed, uuid_key
from fathomline.operators.relational import current
from fathomline.storage import read


def table(spark: SparkSession, root: str, name: str, where: Column | None = None) -> DataFrame:
    """A table's rows for which a condition holds. It is put below the deduplication, so that it reaches the scan."""
    rows = read(spark, root, name)
    return current(rows if where is None else rows.where(where))


def files(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    return table(spark, root, "files", where).withColumn("status", S.normal(F.col("processing_status")))


def tenants(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tenants").withColumn("name", F.trim("name"))


def embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Chunk keys as UUIDs with dashes, however they are written."""
    return table(spark, root, "chunk_embeddings").withColumn("content_chunk_id", dashed(uuid_key(F.col("content_chunk_id"))))


def raw_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """The same with re-delivered rows, for operators that drop these themselves."""
    return read(spark, root, "chunk_embeddings").withColumn("content_chunk_id", dashed(uuid_key(F.col("content_chunk_id"))))


def jobs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "processing_jobs").withColumn("file_id", dashed(uuid_key(F.col("file_id"))))


def raw_assets(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "file_assets").withColumn("file_id", dashed(uuid_key(F.col("file_id"))))


def assets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "file_assets").withColumn("file_id", dashed(uuid_key(F.col("file_id"))))


def api_keys(spark: SparkSession, root: str) -> DataFrame:
    """Stand-ins made from customers: keys of nations as tenants."""
    c = read(spark, root, "customer")
    day = F.timestamp_micros(F.lit(1704067200000000) + F.col("c_custkey").cast("bigint") % 90 * 86_400_000_000)
    revoked = F.when(F.col("c_acctbal") < 0, F.timestamp_micros(F.lit(1706745600000000)))
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.sha2(F.col("c_name").cast("binary"), 256).alias("key_hash"),
        F.substring("c_name", 1, 16).alias("key_prefix"),
        F.col("c_mktsegment").alias("name"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        revoked.alias("revoked_at"),
        day.alias("created_at"),
    )


def nations(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("is_active"))


def search_log(spark: SparkSession, root: str) -> DataFrame:
    """Stand-ins made from events."""
    e = read(spark, root, "events")
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), (F.col("user_id") % 25).cast("string").alias("tenant_id"), F.col("event_type").alias("query_text"), F.col("value").cast("int").alias("results_count"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def job_events(spark_events: DataFrame) -> DataFrame:
    """Events of jobs made from events: (key, id, at, kind, value, message)."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "cancel")
    return spark_events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), (F.col("value") / 1000).alias("value"), F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("message"))


# The same tables in SQL, by name, for the comparison.
_BARE = "lower(regexp_replace(trim({0}), '[-{{}}]', '', 'g'))"


def sql_key(c: str) -> str:
    b = _BARE.format(c)
    return f"CASE WHEN regexp_full_match({b}, '[0-9a-f]{{32}}') THEN concat_ws('-', {b}[1:8], {b}[9:12], {b}[13:16], {b}[17:20], {b}[21:32]) END"


def sql_time(c: str) -> str:
    return f"strftime(timezone('UTC', {c}), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def sql_status(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('pending','processing','completed','failed') THEN lower(trim({c})) WHEN lower(trim({c})) LIKE 'failed:%' THEN 'failed' END"


SQL = {
    "f": f"SELECT DISTINCT *, {sql_status('processing_status')} AS status FROM files",
    "t": "SELECT DISTINCT * REPLACE (trim(name) AS name) FROM tenants",
    "c": "SELECT DISTINCT * FROM content_chunks",
    "e": f"SELECT DISTINCT * REPLACE ({sql_key('content_chunk_id')} AS content_chunk_id) FROM chunk_embeddings",
    "j": f"SELECT DISTINCT * REPLACE ({sql_key('file_id')} AS file_id) FROM processing_jobs",
    "a": f"SELECT DISTINCT * REPLACE ({sql_key('file_id')} AS file_id) FROM file_assets",
    "k": "SELECT c_custkey::VARCHAR AS id, c_nationkey::VARCHAR AS tenant_id, sha256(c_name) AS key_hash, c_name[1:16] AS key_prefix, c_mktsegment AS name, NULL::TIMESTAMP AS last_used_at, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-01' END AS revoked_at, make_timestamp(1704067200000000 + (c_custkey % 90) * 86400000000) AS created_at FROM customer",
    "n": "SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey <> 0 AS is_active FROM nation",
    "s": "SELECT lpad(event_id::VARCHAR, 12, '0') AS id, (user_id % 25)::VARCHAR AS tenant_id, event_type AS query_text, trunc(value)::INT AS results_count, ts AS created_at FROM events",
    "v": "SELECT user_id::VARCHAR AS key, event_id AS id, ts AS tm, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'cancel' END AS kind, value / 1000 AS value, CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS message FROM events",
}


def sql(tables: str, rest: str) -> str:
    """WITH the named tables, and the rest, which may start with further ones after a comma."""
    return "WITH " + ", ".join(f"{t} AS ({SQL[t]})" for t in tables) + rest
