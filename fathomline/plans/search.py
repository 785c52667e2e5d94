"""Vector search and its grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import ann
from fathomline.operators import retrieval as R
from fathomline.operators.embedding import HashProvider, embedded
from fathomline.operators.relational import scope
from fathomline.plans import tables as P
from fathomline.plans.tables import sql
from fathomline.storage import new_folder, read, stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_OK = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_EOK = _OK.replace("embedding", "e.embedding")
_Q0 = f", q AS (SELECT embedding::DOUBLE[] AS v, tenant_id AS t FROM e WHERE {_OK} AND len(embedding) = 64 AND tenant_id IS NOT NULL ORDER BY id LIMIT 1)"
_S = f"s AS (SELECT e.id, e.content_chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS similarity FROM e, q WHERE {_EOK} AND e.tenant_id = q.t AND len(e.embedding) = len(q.v) AND content_chunk_id IS NOT NULL)"
_Q = f"{_Q0}, {_S}"
#: The same over all tenants.
_ALL = _Q.replace("AND e.tenant_id = q.t ", "")
# A similarity as it is shown.
_R = "round({}::FLOAT::DOUBLE, 5)"


def _shown(c: str) -> Column:
    return F.round(R.narrowed(F.col(c)).cast("double"), 5)


def _asked(e: DataFrame) -> tuple[list[float], str]:
    """The query vector of these queries, the usable one of the smallest id, and its tenant."""
    rows = e.where((F.size("embedding") == 64) & F.col("tenant_id").isNotNull()).select("id", "embedding", "tenant_id")
    usable = V.is_usable(F.col("embedding"))
    # a top-k of ids first: the test of every number of every vector is needed only if none of these is usable
    for some in (rows.orderBy("id").limit(64), rows):
        # a partial minimum by task, no sort
        if row := some.where(usable).agg(F.min_by(F.struct("embedding", "tenant_id"), "id").alias("r")).first()["r"]:
            return list(row["embedding"]), row["tenant_id"]
    raise ValueError("no usable vector")


def _hits(spark: SparkSession, root: str, limit: int, threshold: float | None = None) -> DataFrame:
    e = P.raw_embeddings(spark, root)
    vector, tenant = _asked(e)
    return R.similarity_search(e, vector, limit, threshold, tenant)


def _found(spark: SparkSession, root: str, *tables: str) -> list[DataFrame]:
    """50 hits, and the tables, all of the query's tenant."""
    e = P.raw_embeddings(spark, root)
    vector, tenant = _asked(e)
    read_ = {"file_assets": P.raw_assets(spark, root)}
    return [R.similarity_search(e, vector, 50, None, tenant), *(scope(read_[t] if t in read_ else read(spark, root, t), tenant) for t in tables)]


@query(sql("e", f"{_Q} SELECT id, content_chunk_id, {_R.format('similarity')} AS similarity FROM s ORDER BY s.similarity DESC, id LIMIT 10"))
def similarity_topk(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root, 10).withColumn("similarity", _shown("similarity"))


@query(sql("e", f"{_ALL} SELECT id, content_chunk_id, {_R.format('similarity')} AS similarity FROM s ORDER BY s.similarity DESC, id LIMIT 100"))
def similarity_topk_all_tenants(spark: SparkSession, root: str) -> DataFrame:
    e = P.raw_embeddings(spark, root)
    return R.similarity_search(e, _asked(e)[0], 100).withColumn("similarity", _shown("similarity"))


@query(sql("e", f"{_Q} SELECT id, content_chunk_id, {_R.format('similarity')} AS similarity FROM s WHERE similarity >= 0.1::FLOAT::DOUBLE"))
def similarity_threshold(spark: SparkSession, root: str) -> DataFrame:
    """All of the tenant's hits from a threshold on."""
    e = P.raw_embeddings(spark, root)
    vector, tenant = _asked(e)
    return R.scores(e, vector, 0.1, tenant).withColumn("similarity", _shown("similarity"))


@query(sql("ce", f"{_Q0}, file AS (SELECT min(c.file_id) AS id FROM c JOIN e ON e.content_chunk_id = c.id, q WHERE c.tenant_id = q.t AND e.tenant_id = q.t), {_S} SELECT s.id, s.content_chunk_id, {_R.format('s.similarity')} AS similarity FROM s WHERE s.content_chunk_id IN (SELECT c.id FROM c, file, q WHERE c.file_id = file.id AND c.tenant_id = q.t) ORDER BY s.similarity DESC, s.id LIMIT 10"))
def similarity_in_file(spark: SparkSession, root: str) -> DataFrame:
    """The tenant's best hits in one file: the smallest one that has embeddings."""
    e = P.raw_embeddings(spark, root)
    vector, tenant = _asked(e)
    c = P.table(spark, root, "content_chunks", F.col("tenant_id") == tenant)
    has = e.where(F.col("tenant_id") == tenant).select(F.col("content_chunk_id").alias("id"))
    file = c.join(has, "id", "left_semi").agg(F.min("file_id").alias("f")).first()["f"]
    return R.search_in_file(e, c, file, vector, 10, None, tenant).select("id", "content_chunk_id", _shown("similarity").alias("similarity"))


@query(sql("ce", f"{_ALL}, b AS (SELECT s.*, c.file_id FROM s JOIN c ON c.id = s.content_chunk_id WHERE c.file_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY similarity DESC, id) AS r FROM b) SELECT file_id, id, {_R.format('similarity')} AS similarity FROM r WHERE r = 1"))
def similarity_by_file(spark: SparkSession, root: str) -> DataFrame:
    """The best hit of every file of all tenants."""
    e = P.raw_embeddings(spark, root)
    c = P.table(spark, root, "content_chunks").where(F.col("file_id").isNotNull()).select(F.col("id").alias("content_chunk_id"), "file_id")
    rows = R.scores(e, _asked(e)[0]).join(c, "content_chunk_id")
    best = rows.groupBy("file_id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), F.col("id"))).alias("b"))
    return best.select("file_id", "b.id", (-F.col("b.d")).alias("similarity")).withColumn("similarity", _shown("similarity"))


@query("WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS similarity FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM s) SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def similarity_batch_queries(spark: SparkSession, root: str) -> DataFrame:
    e = read(spark, root, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.batch_search(e.withColumnRenamed("vec_id", "id"), asked, 5).withColumn("similarity", F.round("similarity", 6))


_GROUPED = f"{_Q}, h AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 50)), m AS (SELECT h.*, c.file_id, c.chunk_index, f.file_name FROM q, h JOIN c ON c.id = h.content_chunk_id JOIN f ON f.id = c.file_id WHERE c.tenant_id = q.t AND f.tenant_id = q.t), g AS (SELECT file_id, file_name, min(rank) AS first, count(*) AS n_matches, max(similarity) AS best, list_aggregate(list(content_chunk_id ORDER BY rank), 'string_agg', ',') AS chunks FROM m GROUP BY file_id, file_name)"


@query(sql("cefa", f"{_GROUPED} SELECT row_number() OVER (ORDER BY first)::INT AS position, g.file_id, file_name, n_matches, round(best::FLOAT::DOUBLE, 5) AS best_similarity, chunks, coalesce(n_assets, 0) AS n_assets FROM g LEFT JOIN (SELECT file_id, count(*) AS n_assets FROM a, q WHERE a.tenant_id = q.t GROUP BY file_id) x ON x.file_id = g.file_id"))
def search_grouped_documents(spark: SparkSession, root: str) -> DataFrame:
    """Search, hits joined with chunks, files and assets, grouped by document in order of the first hit."""
    d = R.hydrate_and_group(*_found(spark, root, "content_chunks", "files", "file_assets"))
    return d.select("position", "file_id", "file_name", "n_matches", _shown("best_similarity").alias("best_similarity"), F.array_join(F.transform("matches", lambda m: m["content_chunk_id"]), ",").alias("chunks"), F.coalesce(F.size("assets"), F.lit(0)).cast("bigint").alias("n_assets"))


@query(sql("cef", f"{_GROUPED} SELECT (SELECT count(*) FROM h) AS n_hits, count(*) AS total_documents, sum(n_matches)::BIGINT AS total_chunk_matches FROM g"))
def search_orphan_hits_dropped(spark: SparkSession, root: str) -> DataFrame:
    """Hits whose chunk or file is missing don't count."""
    hits, *tables = _found(spark, root, "content_chunks", "files")
    d = R.hydrate_and_group(hits, *tables)
    return R.tally(d).join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n_hits"))))


@query(sql("cef", f"{_GROUPED} SELECT 't' AS tenant_id, 'words' AS query_text, coalesce(sum(n_matches), 0)::INT AS results_count FROM g"))
def audit_insert(spark: SparkSession, root: str) -> DataFrame:
    d = R.hydrate_and_group(*_found(spark, root, "content_chunks", "files"))
    return R.audit_row(d, "t", "words", F.timestamp_micros(F.lit(1705276800000000))).select("tenant_id", "query_text", "results_count")


@query(sql("e", f" SELECT id, len(embedding)::INT AS dimension, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM e WHERE {_OK}"))
def embedding_norms(spark: SparkSession, root: str) -> DataFrame:
    e = P.embeddings(spark, root).where(V.is_usable(F.col("embedding")))
    return e.select("id", F.size("embedding").alias("dimension"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query(sql("e", f", b AS (SELECT * FROM e WHERE {_OK} AND len(embedding) = 64 AND model_version = '1' ORDER BY id LIMIT 1) SELECT e.id, CASE WHEN e.embedding IS NULL THEN 'missing' WHEN e.model_version IS DISTINCT FROM b.model_version OR e.model_name <> b.model_name THEN 'model' WHEN len(e.embedding) <> 64 THEN 'dimension' WHEN NOT ({_EOK}) THEN 'norm' END AS reason FROM e, b"))
def embedding_pair_compat(spark: SparkSession, root: str) -> DataFrame:
    """Why an embedding can't be compared with the first one of the main model."""
    e = P.embeddings(spark, root)
    first = e.where(V.is_usable(F.col("embedding")) & (F.size("embedding") == 64) & (F.col("model_version") == "1")).orderBy("id").limit(1)
    fields = ("model_name", "model_version", "embedding")
    b = F.broadcast(first.select(F.struct(*fields).alias("b")))  # one row
    return e.join(b).select("id", V.mismatch(F.struct(*fields), F.col("b")).alias("reason"))


@query()
def search_text_documents(spark: SparkSession, root: str) -> DataFrame:
    """A search by text: all chunks embedded by the local provider, the query's vector, the tenant's hits, their documents and the log's row."""
    chunks, files = P.table(spark, root, "content_chunks").where(F.col("tenant_id").isNotNull()), read(spark, root, "files")
    tenant = chunks.agg(F.min("tenant_id").alias("t")).first()["t"]
    mine = scope(chunks, tenant)
    vectors = stage(embedded(mine.select("id", "tenant_id", "chunk_text"), HashProvider).select("id", "tenant_id", F.col("id").alias("content_chunk_id"), "embedding"), "search-vectors")
    found, log = R.text_search("the record of the report and its review", HashProvider(), vectors, mine, files, P.raw_assets(spark, root), tenant, F.timestamp_micros(F.lit(1705276800000000)), 20)
    return found.select("position", "file_id", "file_name", "n_matches", _shown("best_similarity").alias("best_similarity")).join(F.broadcast(log.select(F.col("results_count").alias("logged"))))


@query()
def similarity_index_queries(spark: SparkSession, root: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, by the index: all vectors are indexed, few cells are read for a query."""
    e = read(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    index = ann.build(e, new_folder(spark, "index"))
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return ann.search(index, asked, 5).withColumn("similarity", F.round("similarity", 5))
