"""Lookups, pages, counts and changes of tables, all within a tenant where one is given.

Tables are values: a change returns the table after it, with a count where the caller needs one. Nothing is collected.
Nulls: descending order puts null times first, ascending last, as the store that this replaces does; every order ends
with the id, so that pages are stable among equal times. A null key equals nothing. Empty lists of ids give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Ids up to this many are a list in the plan; more are joined.
LISTED_IDS = 1000


def scope(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def current(df: DataFrame, *order: str) -> DataFrame:
    """One row per id: re-delivered rows count once, the latest by the order where they differ."""
    if not order:
        return df.dropDuplicates(["id"])
    w = Window.partitionBy("id").orderBy(*(F.desc_nulls_last(c) for c in order), F.xxhash64(*df.columns))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_id(df: DataFrame, tenant: str | None, key: str, column: str = "id") -> DataFrame:
    """At most one row."""
    return scope(df, tenant).where(F.col(column) == key).orderBy("id").limit(1)


def by_ids(df: DataFrame, tenant: str | None, ids: Sequence[str]) -> DataFrame:
    rows = scope(df, tenant)
    if len(ids) <= LISTED_IDS:
        return rows.where(F.col("id").isin(*ids)) if ids else rows.limit(0)
    wanted = df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")
    return rows.join(wanted, "id", "left_semi")


def by_hash(files: DataFrame, tenant: str | None, hashes: DataFrame) -> DataFrame:
    """(file_hash, file_id): the tenant's oldest file of each of hashes (file_hash) that has one. Hashes are compared in lower case."""
    asked = hashes.where(F.col("file_hash").isNotNull()).select(F.lower("file_hash").alias("file_hash")).distinct()
    held = scope(files, tenant).where(F.col("file_hash").isNotNull()).select(F.lower("file_hash").alias("file_hash"), "created_at", "id").join(asked, "file_hash", "left_semi")
    return held.groupBy("file_hash").agg(F.min_by("id", F.struct(F.col("created_at").isNull(), "created_at", "id")).alias("file_id"))


def checked_embedding(embeddings: DataFrame, tenant: str | None, key: str) -> DataFrame:
    """(id, content_chunk_id, embedding, error): one embedding; one without a vector or chunk has an error instead of being returned as whole."""
    error = F.when(F.col("embedding").isNull() | (F.size("embedding") == 0), F.lit("no vector")).when(F.col("content_chunk_id").isNull(), F.lit("no chunk"))
    return by_id(embeddings, tenant, key).select("id", "content_chunk_id", "embedding", error.alias("error"))


def asset_of_file(assets: DataFrame, tenant: str | None, file: str, key: str) -> DataFrame:
    """An asset, only if it belongs to that file."""
    return by_id(scope(assets, tenant).where(F.col("file_id") == file), None, key)


def create_keys(keys: DataFrame, tenants: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The keys to add for requests (tenant_id, name, raw_key), and a summary (id, tenant_id, name, key_prefix, created_at) of each.

    Only for active tenants, only with a name that isn't blank, which is trimmed; a key that exists already is left out. The
    raw key isn't kept: only its hash and its first 16 characters are.
    """
    live = tenants.where("is_active").select(F.col("id").alias("tenant_id"))
    name = F.regexp_replace("name", r"(?U)^\s+|\s+$", "")
    good = requests.where(F.col("raw_key").isNotNull() & (F.length(name) > 0)).join(live, "tenant_id", "left_semi")
    digest = F.sha2(F.col("raw_key").cast("binary"), 256)
    new = good.select(F.substring(digest, 1, 32).alias("id"), "tenant_id", digest.alias("key_hash"), T.key_prefix(F.col("raw_key")).alias("key_prefix"), name.alias("name"), F.lit(None).cast("timestamp").alias("last_used_at"), F.lit(None).cast("timestamp").alias("revoked_at"), now.alias("created_at"))
    new = new.dropDuplicates(["key_hash"]).join(keys.select("key_hash"), "key_hash", "left_anti").select(*new.columns)
    return new, new.select("id", "tenant_id", "name", "key_prefix", "created_at")


def page(df: DataFrame, skip: int, limit: int, *order: Column) -> DataFrame:
    """Rows skip to skip + limit in that order, then by id: a top-k, not a sort of the table."""
    return df.orderBy(*order, "id").offset(max(skip, 0)).limit(limit)


def newest(column: str = "created_at") -> Column:
    return F.desc_nulls_first(column)


def oldest(column: str = "created_at") -> Column:
    return F.asc_nulls_last(column)


def file_page(files: DataFrame, tenant: str, skip: int = 0, limit: int = 20) -> DataFrame:
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip must be at least 0 and limit from 1 to 1000")
    return page(scope(files, tenant), skip, limit, newest())


def chunk_page(chunks: DataFrame, tenant: str, file: str, skip: int = 0, limit: int = 50) -> DataFrame:
    return page(scope(chunks, tenant).where(F.col("file_id") == file), skip, min(limit, 100), F.asc_nulls_last("chunk_index"))


def audit_page(queries: DataFrame, tenant: str, skip: int = 0, limit: int = 20) -> DataFrame:
    return page(scope(queries, tenant), skip, min(max(limit, 1), 100), newest())


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first by the order and then by id: partial minima are made before the shuffle."""
    rest = [c for c in df.columns if c not in (key, "id", *order)]
    row = F.struct(*(F.col(c) for c in (*order, "id", *rest)))
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*order, "id")).alias("r"))
    return firsts.select(key, "r.*").select(*df.columns)


def stale(files: DataFrame, statuses: Sequence[str], seconds: int, as_of: Column) -> DataFrame:
    """Rows of all tenants in one of the states that were last updated before as_of minus seconds."""
    return files.where(F.col("status").isin(*statuses) & (F.col("updated_at") < as_of - F.make_dt_interval(secs=F.lit(seconds))))


def delete(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What is kept, and the number of deleted rows as a table of one row."""
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.where(gone).agg(F.count(F.lit(1)).alias("n_deleted"))


def cascade(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, assets: DataFrame, jobs: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files whose ids are in gone (id), and without all that hangs on these. Only ids are joined."""
    ids = gone.select("id").distinct()
    chain = chunks.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("content_chunk_id")).distinct()
    without = lambda df: df.join(ids.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(*df.columns)
    return {
        "files": files.join(ids, "id", "left_anti"),
        "chunks": without(chunks),
        "embeddings": embeddings.join(chain, "content_chunk_id", "left_anti").select(*embeddings.columns),
        "assets": without(assets),
        "jobs": without(jobs),
    }


def upsert(df: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the columns of the rows whose id is in changes overwritten; changes has one row per id. Other ids change nothing."""
    new = changes.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(new, "id", "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def append_new(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys aren't in df and don't come earlier (by id) in rows: a guard against duplicates. Null keys pass."""
    w = Window.partitionBy(*keys).orderBy("id")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = rows.withColumn("_r", F.when(known, F.row_number().over(w)).otherwise(F.lit(1))).where("_r = 1").drop("_r")
    return first.join(df.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def resolve_keys(keys: DataFrame, tenants: DataFrame, hashes: DataFrame) -> DataFrame:
    """(key_hash, key_id, tenant_id) of the hashes that a key has which isn't revoked and whose tenant is active."""
    live = keys.where(F.col("revoked_at").isNull()).join(hashes.select("key_hash").distinct(), "key_hash", "left_semi")
    active = tenants.where("is_active").select(F.col("id").alias("tenant_id"))
    return live.join(active, "tenant_id").select("key_hash", F.col("id").alias("key_id"), "tenant_id")


def revoke(keys: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The keys with those in ids revoked that weren't, and the number of changes."""
    hit = keys.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    change = F.coalesce("_hit", F.lit(False)) & F.col("revoked_at").isNull()
    after = hit.select(*(F.when(change, now).otherwise(F.col(c)).alias(c) if c == "revoked_at" else F.col(c) for c in keys.columns))
    return after, hit.agg(F.count_if(change).alias("n_changed"))


def last_used(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """The keys with last_used_at of the latest use. uses: (key_id, used_at)."""
    last = uses.groupBy("key_id").agg(F.max("used_at").alias("_used")).withColumnRenamed("key_id", "id")
    both = keys.join(last, "id", "left")
    return both.select(*(F.greatest("last_used_at", "_used").alias(c) if c == "last_used_at" else F.col(c) for c in keys.columns))
