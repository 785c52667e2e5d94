"""Lookups, pages, counts, joins and changes over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import metadata as M
from fathomline.functions import status as S
from fathomline.functions import text as T
from fathomline.functions import times
from fathomline.functions import urls as U
from fathomline.operators import relational as R
from fathomline.operators import retrieval
from fathomline.plans import tables as P
from fathomline.plans.tables import sql, sql_time
from fathomline.storage import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def least(df: DataFrame, column: str):
    """A parameter for lookups: the smallest value of a column."""
    return df.agg(F.min(column).alias("x")).first()["x"]


_T0 = "(SELECT min(tenant_id) FROM f)"


@query(sql("f", f" SELECT id, file_name, file_type, file_size, status, {sql_time('created_at')} AS created, {sql_time('updated_at')} AS updated FROM f WHERE tenant_id = {_T0} ORDER BY f.created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 5"))
def file_list_page(spark: SparkSession, root: str) -> DataFrame:
    tenant = least(read(spark, root, "files"), "tenant_id")
    page = R.file_page(P.files(spark, root, F.col("tenant_id") == tenant), tenant, 5, 20)
    return page.select("id", "file_name", "file_type", "file_size", "status", times.rfc3339(F.col("created_at")).alias("created"), times.rfc3339(F.col("updated_at")).alias("updated"))


@query(sql("f", " SELECT tenant_id, count(*) AS n FROM f GROUP BY tenant_id"))
def file_count_by_tenant(spark: SparkSession, root: str) -> DataFrame:
    return R.counted(P.files(spark, root), "tenant_id")


@query(sql("f", f" SELECT id, file_path, file_name, coalesce(file_size, 0) AS file_size, coalesce(file_hash, '') AS file_hash, tenant_id || '/' || id AS storage_key, {sql_time('created_at')} AS created FROM f"))
def file_detail(spark: SparkSession, root: str) -> DataFrame:
    f = P.files(spark, root)
    return f.select("id", "file_path", "file_name", F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("file_hash", F.lit("")).alias("file_hash"), U.storage_key(F.col("tenant_id"), F.col("id")).alias("storage_key"), times.rfc3339(F.col("created_at")).alias("created"))


@query(sql("f", " SELECT id, file_name FROM f WHERE id = (SELECT min(id) FROM f)"))
def file_by_id(spark: SparkSession, root: str) -> DataFrame:
    key = least(read(spark, root, "files"), "id")
    return R.by_id(P.files(spark, root, F.col("id") == key), None, key).select("id", "file_name")


@query(sql("fj", " SELECT f.id, f.file_name, f.status FROM f WHERE f.id IN (SELECT file_id FROM j WHERE job_type ILIKE 'youtube_extraction')"))
def file_find_by_ids(spark: SparkSession, root: str) -> DataFrame:
    """A batch of ids that is itself a table is a semi join."""
    wanted = P.jobs(spark, root).where(S.job_type(F.col("job_type")) == "youtube_extraction").select(F.col("file_id").alias("id"))
    return P.files(spark, root).join(wanted, "id", "left_semi").select("id", "file_name", "status")


@query(sql("f", ", r AS (SELECT lower(file_hash) AS file_hash, id, row_number() OVER (PARTITION BY lower(file_hash) ORDER BY created_at NULLS LAST, id) AS r FROM f WHERE file_hash IS NOT NULL AND tenant_id = (SELECT tenant_id FROM f WHERE file_hash IS NOT NULL ORDER BY id LIMIT 1)) SELECT file_hash, id AS file_id FROM r WHERE r = 1"))
def file_find_by_hash(spark: SparkSession, root: str) -> DataFrame:
    """A tenant's files by content: all known digests, written in capitals, and one that nothing has."""
    f = P.files(spark, root)
    tenant = f.where(F.col("file_hash").isNotNull()).agg(F.min_by("tenant_id", "id").alias("t")).first()["t"]
    asked = f.select(F.upper("file_hash").alias("file_hash")).unionByName(spark.createDataFrame([("0" * 64,), (None,)], "file_hash string"))
    return R.by_hash(f, tenant, asked)


@query(sql("c", " SELECT id, file_id, chunk_index, sha256(chunk_text) AS digest FROM c WHERE id = (SELECT min(id) FROM c)"))
def chunk_by_id(spark: SparkSession, root: str) -> DataFrame:
    key = least(read(spark, root, "content_chunks"), "id")
    return R.by_id(P.table(spark, root, "content_chunks", F.col("id") == key), None, key).select("id", "file_id", "chunk_index", T.sha256(F.col("chunk_text")).alias("digest"))


@query(sql("e", ", k AS (SELECT min(id) AS id FROM e UNION ALL SELECT min(id) FROM e WHERE embedding IS NULL UNION ALL SELECT min(id) FROM e WHERE embedding IS NOT NULL AND content_chunk_id IS NULL) SELECT id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'no vector' WHEN content_chunk_id IS NULL THEN 'no chunk' END AS error FROM e WHERE id IN (SELECT id FROM k)"))
def embedding_by_id_checked(spark: SparkSession, root: str) -> DataFrame:
    """Three lookups: of a whole embedding, of one without a vector, of one without a chunk."""
    e = P.embeddings(spark, root)
    keys = e.agg(F.min("id").alias("a"), F.min(F.when(F.col("embedding").isNull(), F.col("id"))).alias("b"), F.min(F.when(F.col("embedding").isNotNull() & F.col("content_chunk_id").isNull(), F.col("id"))).alias("c")).first()
    found = [R.checked_embedding(e, None, k).select("id", "error") for k in dict.fromkeys(k for k in keys if k is not None)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query(sql("j", " SELECT id, file_id, lower(trim(job_type)) AS job_type FROM j WHERE id = (SELECT max(id) FROM j)"))
def job_by_id(spark: SparkSession, root: str) -> DataFrame:
    j = P.jobs(spark, root)
    key = j.agg(F.max("id").alias("x")).first()["x"]
    return R.by_id(j, None, key).select("id", "file_id", S.job_type(F.col("job_type")).alias("job_type"))


@query(sql("a", ", k AS (SELECT id, file_id FROM a WHERE file_id IS NOT NULL ORDER BY id LIMIT 1) SELECT a.id, a.file_id, a.storage_key FROM a, k WHERE a.id = k.id AND a.file_id = k.file_id"))
def asset_of_file(spark: SparkSession, root: str) -> DataFrame:
    """An asset by its id and its file's; with another file's there is none."""
    a = P.assets(spark, root)
    first = a.where(F.col("file_id").isNotNull()).agg(F.min_by(F.struct("id", "file_id"), "id").alias("r")).first()["r"]
    wrong = R.asset_of_file(a, None, "another file", first["id"])
    return R.asset_of_file(a, None, first["file_id"], first["id"]).unionByName(wrong).select("id", "file_id", "storage_key")


@query(sql("f", ", old AS (SELECT * FROM f WHERE created_at < TIMESTAMPTZ '2024-07-01 00:00:00+00'), new AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, file_hash ORDER BY id) AS r FROM f WHERE NOT coalesce(created_at < TIMESTAMPTZ '2024-07-01 00:00:00+00', FALSE)) SELECT id, tenant_id, file_hash FROM new WHERE (file_hash IS NULL OR r = 1) AND NOT EXISTS (SELECT 1 FROM old WHERE old.tenant_id = new.tenant_id AND old.file_hash = new.file_hash)"))
def file_hash_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Files that an upload would accept: no earlier one of the tenant has the content."""
    f = P.files(spark, root)
    before = F.coalesce(F.col("created_at") < F.timestamp_micros(F.lit(1719792000000000)), F.lit(False))
    return R.append_new(f.where(before), f.where(~before), ["tenant_id", "file_hash"]).select("id", "tenant_id", "file_hash")


@query(sql("f", " SELECT CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS n_changed FROM f GROUP BY 1"))
def file_update_overwrite(spark: SparkSession, root: str) -> DataFrame:
    f = P.files(spark, root)
    after = R.upsert(f, f.where("status = 'failed'").select("id", F.lit("pending").alias("status")), ["status"])
    both = after.select("id", "status").join(f.select("id", F.col("status").alias("old")), "id")
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") == "failed").alias("n_changed"))


@query(sql("fceaj", ", g AS (SELECT id FROM f WHERE status = 'failed'), gc AS (SELECT id FROM c WHERE file_id IN (SELECT id FROM g)) SELECT 'files' AS tbl, count(*) AS n FROM f WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chunks', count(*) FROM c WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'embeddings', count(*) FROM e WHERE content_chunk_id IS NULL OR content_chunk_id NOT IN (SELECT id FROM gc) UNION ALL SELECT 'assets', count(*) FROM a WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'jobs', count(*) FROM j WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g)"))
def file_delete_cascade(spark: SparkSession, root: str) -> DataFrame:
    f, c, e, a, j = P.files(spark, root), P.table(spark, root, "content_chunks"), P.embeddings(spark, root), P.assets(spark, root), P.jobs(spark, root)
    left = R.cascade(f, c, e, a, j, f.where("status = 'failed'"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql("ce", " SELECT count(*) AS n_deleted FROM e WHERE content_chunk_id IN (SELECT id FROM c WHERE file_id = (SELECT min(file_id) FROM c))"))
def embedding_delete_by_file(spark: SparkSession, root: str) -> DataFrame:
    """The subquery is a semi join, without a trip to the driver."""
    c = P.table(spark, root, "content_chunks")
    own = c.where(F.col("file_id") == least(c, "file_id")).select(F.col("id").alias("content_chunk_id")).distinct().withColumn("own", F.lit(True))
    e = P.embeddings(spark, root).join(own, "content_chunk_id", "left")
    return R.delete(e, F.col("own"))[1]


@query(sql("c", " SELECT id, chunk_index, chunk_text FROM c WHERE file_id = (SELECT min(file_id) FROM c) ORDER BY chunk_index NULLS LAST, id LIMIT 100"))
def chunk_page(spark: SparkSession, root: str) -> DataFrame:
    file = least(read(spark, root, "content_chunks"), "file_id")
    c = P.table(spark, root, "content_chunks", F.col("file_id") == file)
    tenant = least(c, "tenant_id")
    return R.chunk_page(c, tenant, file, 0, 500).select("id", "chunk_index", "chunk_text")


@query(sql("c", " SELECT file_id, count(*) AS n FROM c WHERE file_id IS NOT NULL GROUP BY file_id"))
def chunk_count_by_file(spark: SparkSession, root: str) -> DataFrame:
    return R.counted(P.table(spark, root, "content_chunks").where(F.col("file_id").isNotNull()), "file_id")


@query(sql("ce", " SELECT e.id, e.content_chunk_id, c.file_id, c.chunk_index FROM e JOIN c ON c.id = e.content_chunk_id"))
def embeddings_by_file(spark: SparkSession, root: str) -> DataFrame:
    c = P.table(spark, root, "content_chunks").select(F.col("id").alias("content_chunk_id"), "file_id", "chunk_index")
    return P.embeddings(spark, root).select("id", "content_chunk_id").join(c, "content_chunk_id").select("id", "content_chunk_id", "file_id", "chunk_index")


@query(sql("e", " SELECT id, content_chunk_id, model_name FROM (SELECT *, row_number() OVER (PARTITION BY content_chunk_id ORDER BY generated_at NULLS FIRST, id) AS r FROM e WHERE content_chunk_id IS NOT NULL) WHERE r = 1"))
def embedding_first_by_chunk(spark: SparkSession, root: str) -> DataFrame:
    e = P.embeddings(spark, root).select("id", "content_chunk_id", "model_name", "generated_at")
    return R.first_per(e, "content_chunk_id", "generated_at").select("id", "content_chunk_id", "model_name")


@query(sql("e", " SELECT tenant_id, count(*) AS n FROM e GROUP BY tenant_id"))
def embedding_count_by_tenant(spark: SparkSession, root: str) -> DataFrame:
    return R.counted(P.embeddings(spark, root), "tenant_id")


@query(sql("e", f" SELECT id, content_chunk_id, model_name, model_version, coalesce(len(embedding), -1)::INT AS dimension, {sql_time('generated_at')} AS generated FROM e"))
def vector_dimension(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings without their vectors; -1 for a null one."""
    e = P.embeddings(spark, root)
    return e.select("id", "content_chunk_id", "model_name", "model_version", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dimension"), times.rfc3339(F.col("generated_at")).alias("generated"))


@query(sql("j", f" SELECT id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC NULLS FIRST, id)::INT AS position, {sql_time('created_at')} AS created FROM j WHERE file_id IS NOT NULL"))
def jobs_by_file(spark: SparkSession, root: str) -> DataFrame:
    """Each file's jobs, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy(R.newest(), "id")
    return P.jobs(spark, root).where(F.col("file_id").isNotNull()).select("id", "file_id", F.row_number().over(w).alias("position"), times.rfc3339(F.col("created_at")).alias("created"))


@query(sql("a", " SELECT file_id, count(*) AS n_assets, min(label) AS first_label, list_aggregate(list(id ORDER BY created_at NULLS LAST, id), 'string_agg', ',') AS ids FROM a WHERE file_id IS NOT NULL GROUP BY file_id"))
def assets_by_file(spark: SparkSession, root: str) -> DataFrame:
    """Each file's assets nested, oldest first."""
    a = P.assets(spark, root).where(F.col("file_id").isNotNull())
    return retrieval.nested_assets(a).select("file_id", F.size("assets").cast("bigint").alias("n_assets"), F.array_min(F.transform("assets", lambda x: x["label"])).alias("first_label"), F.array_join(F.transform("assets", lambda x: x["id"]), ",").alias("ids"))


@query(sql("a", " SELECT id, CASE WHEN lower(trim(asset_type)) = 'image' THEN 'image' ELSE 'other' END AS asset_type, lower(content_type) AS content_type, byte_size, '/files/' || coalesce(file_id, 'null') || '/assets/' || id || '/content' AS download_url FROM a"))
def asset_projection(spark: SparkSession, root: str) -> DataFrame:
    a = P.assets(spark, root)
    return a.select("id", S.asset_type(F.col("asset_type")).alias("asset_type"), F.lower("content_type").alias("content_type"), "byte_size", U.asset_url(F.coalesce("file_id", F.lit("null")), F.col("id")).alias("download_url"))


@query(sql("fca", " SELECT f.id AS file_id, f.file_name, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_assets, 0) AS n_assets, coalesce(chunk_ids, '') AS chunk_ids FROM f LEFT JOIN (SELECT file_id, count(*) AS n_chunks, list_aggregate(list(id ORDER BY chunk_index, id), 'string_agg', ',') AS chunk_ids FROM c GROUP BY file_id) x ON x.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n_assets FROM a GROUP BY file_id) y ON y.file_id = f.id"))
def document_view(spark: SparkSession, root: str) -> DataFrame:
    """Each file with its chunks and assets nested."""
    v = retrieval.document_view(P.files(spark, root), P.table(spark, root, "content_chunks"), P.assets(spark, root))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return v.select("file_id", "file_name", n("chunks").alias("n_chunks"), n("assets").alias("n_assets"), F.coalesce(F.array_join(F.transform("chunks", lambda x: x["id"]), ","), F.lit("")).alias("chunk_ids"))


@query(sql("t", f" SELECT id, name, is_active, {sql_time('created_at')} AS created, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id)::INT AS position FROM t"))
def tenants_list(spark: SparkSession, root: str) -> DataFrame:
    """All tenants, newest first. The table of tenants is small: the global order is meant."""
    from pyspark.sql import Window

    w = Window.orderBy(R.newest(), "id")
    return P.tenants(spark, root).select("id", "name", "is_active", times.rfc3339(F.col("created_at")).alias("created"), F.row_number().over(w).alias("position"))


@query(sql("k", " SELECT id, tenant_id, key_prefix, name, revoked_at IS NULL AS is_live, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC NULLS FIRST, id)::INT AS position FROM k"))
def api_key_list(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("tenant_id").orderBy(R.newest(), "id")
    return P.api_keys(spark, root).select("id", "tenant_id", "key_prefix", "name", F.col("revoked_at").isNull().alias("is_live"), F.row_number().over(w).alias("position"))


@query(sql("kn", " SELECT k.key_hash, k.id AS key_id, k.tenant_id FROM k JOIN n ON n.id = k.tenant_id WHERE n.is_active AND k.revoked_at IS NULL"))
def resolve_api_key(spark: SparkSession, root: str) -> DataFrame:
    k = P.api_keys(spark, root)
    return R.resolve_keys(k, P.nations(spark, root), k.select("key_hash"))


@query(sql("k", " SELECT count(*) FILTER (WHERE revoked_at IS NULL AND tenant_id = '3') AS n_changed, count(*) FILTER (WHERE revoked_at IS NOT NULL OR tenant_id = '3') AS n_revoked FROM k"))
def revoke_api_key(spark: SparkSession, root: str) -> DataFrame:
    k = P.api_keys(spark, root)
    after, changed = R.revoke(k, k.where("tenant_id = '3'"), F.timestamp_micros(F.lit(1709251200000000)))
    return changed.join(F.broadcast(after.agg(F.count("revoked_at").alias("n_revoked"))))


@query(sql("k", ", u AS (SELECT (o_custkey)::VARCHAR AS key_id, max(o_orderdate) AS used FROM orders GROUP BY 1) SELECT k.id, strftime(u.used, '%Y-%m-%d') AS last_used FROM k LEFT JOIN u ON u.key_id = k.id"))
def last_used_at(spark: SparkSession, root: str) -> DataFrame:
    uses = read(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("key_id"), F.col("o_orderdate").cast("timestamp").alias("used_at"))
    return R.last_used(P.api_keys(spark, root), uses).select("id", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


@query(sql("kn", " SELECT k.id, k.tenant_id FROM k WHERE EXISTS (SELECT 1 FROM n WHERE n.id = k.tenant_id AND n.is_active) AND trim(k.name) <> ''"))
def create_key_guard(spark: SparkSession, root: str) -> DataFrame:
    """Keys that may be made: of an active tenant, with a name."""
    live = P.nations(spark, root).where("is_active").select(F.col("id").alias("tenant_id"))
    return P.api_keys(spark, root).where(~T.is_empty(F.col("name"))).join(live, "tenant_id", "left_semi").select("id", "tenant_id")


@query(sql("k", ", x AS (SELECT id, CASE WHEN id::BIGINT % 3 = 0 THEN ['read', 'superuser'] WHEN id::BIGINT % 3 = 1 THEN ['read', 'write'] ELSE [] END AS scopes FROM k) SELECT id, len(list_filter(scopes, lambda s: s NOT IN ('read', 'write', 'admin')))::INT AS n_unknown FROM x"))
def key_scope_validation(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("id").cast("bigint") % 3
    scopes = F.when(n == 0, F.array(F.lit("read"), F.lit("superuser"))).when(n == 1, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array().cast("array<string>"))
    return P.api_keys(spark, root).select("id", F.size(S.unknown_scopes(scopes)).alias("n_unknown"))


@query(sql("s", " SELECT id, query_text, results_count FROM s WHERE tenant_id = '7' ORDER BY created_at DESC NULLS FIRST, id LIMIT 100 OFFSET 10"))
def audit_log_page(spark: SparkSession, root: str) -> DataFrame:
    return R.audit_page(P.search_log(spark, root), "7", 10, 500).select("id", "query_text", "results_count")


@query(sql("f", " SELECT id, json_valid(metadata) AND json_type(metadata) = 'OBJECT' AS is_object, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.author') = 'VARCHAR' THEN json_extract_string(metadata, '$.author') END AS author, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.language') = 'VARCHAR' THEN lower(json_extract_string(metadata, '$.language')) END AS language, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.page_count') IN ('UBIGINT', 'BIGINT') THEN json_extract(metadata, '$.page_count')::BIGINT END AS page_count FROM (SELECT id, coalesce(metadata, '{}') AS metadata FROM f)").replace("json_valid(metadata) AND json_type(metadata) = 'OBJECT' AS", "CASE WHEN json_valid(metadata) THEN json_type(metadata) = 'OBJECT' ELSE FALSE END AS"))
def metadata_typed_get(spark: SparkSession, root: str) -> DataFrame:
    """Typed values of the metadata; broken JSON has none."""
    m = F.coalesce("metadata", F.lit("{}"))
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(m)).startswith("OBJECT"), F.lit(False))
    return P.files(spark, root).select("id", kind.alias("is_object"), M.text_value(m, "author").alias("author"), F.lower(M.text_value(m, "language")).alias("language"), M.whole_value(m, "page_count").alias("page_count"))


@query(sql("f", ", x AS (SELECT id, CASE WHEN metadata IS NOT NULL AND json_valid(metadata) THEN CASE WHEN json_type(metadata) = 'OBJECT' THEN metadata END END AS m FROM f) SELECT id, len(list_distinct(list_concat(coalesce(json_keys(m), []), ['language', 'checked'])))::INT AS n_keys, 'und' AS language FROM x"))
def metadata_merge(spark: SparkSession, root: str) -> DataFrame:
    """Metadata with two keys written over it: the last writer wins."""
    new = F.create_map(F.lit("language"), F.lit("und"), F.lit("checked"), F.lit("true"))
    both = M.merged(M.as_map(F.col("metadata")), new)
    return P.files(spark, root).select("id", F.size(both).alias("n_keys"), F.element_at(both, "language").alias("language"))


@query(sql("kn", ", r AS (SELECT id, tenant_id, trim(name) || ' ' AS name, 'pk_live_' || sha256(key_hash) AS raw FROM k) SELECT substr(sha256(raw), 1, 32) AS id, r.tenant_id, trim(r.name) AS name, substr(raw, 1, 16) AS key_prefix FROM r JOIN n ON n.id = r.tenant_id WHERE n.is_active AND trim(r.name) <> ''"))
def create_api_keys(spark: SparkSession, root: str) -> DataFrame:
    """New keys for tenants, told as a summary: only of active tenants, names trimmed, the key itself not kept."""
    k = P.api_keys(spark, root)
    asked = k.select("tenant_id", F.concat("name", F.lit(" ")).alias("name"), F.concat(F.lit("pk_live_"), T.sha256(F.col("key_hash"))).alias("raw_key"))
    return R.create_keys(k, P.nations(spark, root), asked, F.timestamp_micros(F.lit(1709251200000000)))[1].select("id", "tenant_id", "name", "key_prefix")
