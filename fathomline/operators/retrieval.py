"""Vector search, and its hits joined with chunks, files and assets and grouped by document.

Scores are cosines in double precision. Unusable vectors (null, zero, NaN, of another length than the query's) are no hits.
Hits whose chunk or file is missing are dropped. Ties are broken by id. The limit counts chunks, and is the only thing
that is cut: a top-k report.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators.embedding import Provider
from fathomline.operators.relational import scope
from fathomline.storage import spread, stage

#: What a threshold that isn't given stands for: any cosine.
ANY = -1.0
#: Queries of one block: they are sent to every task.
MOST_QUERIES = 10_000
#: Hits that are grouped at once.
MOST_HITS = 1000


def check_limit(limit: int) -> int:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return limit


def narrowed(similarity: Column) -> Column:
    """A similarity as it is reported: a 4-byte number. Hits are ranked and compared before that."""
    return similarity.cast("float")


def scores(embeddings: DataFrame, query: list[float], threshold: float | None = None, tenant: str | None = None) -> DataFrame:
    """(id, content_chunk_id, similarity) of the tenant's usable embeddings from the threshold on, which is a 4-byte number.

    No tenant: those of all, as a manager of the whole service searches.

    Embeddings that are delivered again count once: they are dropped after scoring, when no vector has to be moved.
    """
    least = F.lit(ANY if threshold is None else threshold).cast("float").cast("double")
    rows = spread(scope(embeddings, tenant).where(F.col("content_chunk_id").isNotNull() & F.col("embedding").isNotNull()).select("id", "content_chunk_id", "embedding"))
    return V.scored(rows, "embedding", query).where(F.col("similarity") >= least).dropDuplicates(["id"])


def similarity_search(embeddings: DataFrame, query: list[float], limit: int = 10, threshold: float | None = None, tenant: str | None = None) -> DataFrame:
    """(id, content_chunk_id, similarity) of the tenant's limit best hits. Each batch keeps its best before anything is shuffled."""
    check_limit(limit)
    least = F.lit(ANY if threshold is None else threshold).cast("float").cast("double")
    rows = spread(scope(embeddings, tenant).where(F.col("content_chunk_id").isNotNull() & F.col("embedding").isNotNull()).select("id", "content_chunk_id", "embedding"))
    best = V.best_of(rows, "id", "embedding", [("q", query)], limit, ("content_chunk_id",)).drop("query_id").dropDuplicates(["id"])
    return best.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit)


def search_in_file(embeddings: DataFrame, chunks: DataFrame, file: str, query: list[float], limit: int = 10, threshold: float | None = None, tenant: str | None = None) -> DataFrame:
    """The limit best hits among the chunks of one of the tenant's files."""
    own = scope(chunks, tenant).where(F.col("file_id") == file).select(F.col("id").alias("content_chunk_id")).distinct()
    return scores(embeddings, query, threshold, tenant).join(own, "content_chunk_id", "left_semi").orderBy(F.desc("similarity"), "id").limit(check_limit(limit))


def query_vector(text: str, provider: Provider) -> list[float]:
    """The vector of a query's text; an error for blank texts, and if the provider gives none."""
    if not text or not text.strip():
        raise ValueError("the query has no text")
    found = provider.embed([text])
    if not found or not len(found[0]):
        raise ValueError("no vector came back for the query")
    return [float(x) for x in found[0]]


def text_search(text: str, provider: Provider, embeddings: DataFrame, chunks: DataFrame, files: DataFrame, assets: DataFrame, tenant: str, now: Column, limit: int = 10, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """A search by text within a tenant: the grouped documents, and the row to append to the search log."""
    hits = similarity_search(embeddings, query_vector(text, provider), limit, threshold, tenant)
    documents = hydrate_and_group(hits, scope(chunks, tenant), scope(files, tenant), scope(assets, tenant))
    return documents, audit_row(documents, tenant, text, now)


def batch_search(embeddings: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, rank, id, similarity): the limit best hits of each query (query_id, vector), of which there may be any number.

    The stated queries go to all embeddings, in blocks of MOST_QUERIES; each batch keeps its limit best rows a query, and
    only these are shuffled. The hits of full blocks are staged, so that the driver holds the queries of one block.
    """
    check_limit(limit)
    asked = queries.where(V.is_usable(F.col("vector"))).select("query_id", "vector").toLocalIterator()
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = spread(embeddings.where(F.col("embedding").isNotNull()).select("id", "embedding"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    parts: list[DataFrame] = []
    full = True
    while full:
        block = [(r["query_id"], r["vector"]) for r in islice(asked, MOST_QUERIES)]
        full = len(block) == MOST_QUERIES
        best = V.best_of(rows, "id", "embedding", block, limit, (), kind).distinct().withColumn("rank", rank).where(F.col("rank") <= limit)
        parts.append(stage(best, "hits") if full else best)
    return reduce(DataFrame.unionByName, parts)


def nested_assets(assets: DataFrame) -> DataFrame:
    """(file_id, assets): each file's assets, oldest first."""
    row = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "id", "asset_type", "content_type", "page_number", "label", "byte_size")
    return assets.groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("assets"))


def hydrate_and_group(hits: DataFrame, chunks: DataFrame, files: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(position, file_id, file_name, n_matches, best_similarity, matches, assets) of the documents that have hits.

    Documents come in the order of their first hit, and matches in the order of hits; both are carried as ranks. hits is a
    top-k result of at most MOST_HITS rows: it becomes a list of ids, which reaches the scans of chunks, files and assets
    as a filter. Rows of these tables that are delivered again count once.
    """
    top = hits.orderBy(F.desc("similarity"), "id").limit(MOST_HITS + 1).collect()
    if len(top) > MOST_HITS:
        raise ValueError(f"more than {MOST_HITS} hits: hits must be a top-k result")
    spark = hits.sparkSession
    ranked = spark.createDataFrame([(k, r["content_chunk_id"], r["similarity"]) for k, r in enumerate(top, 1)], "rank int, content_chunk_id string, similarity double")
    text = chunks.where(F.col("id").isin(*{r["content_chunk_id"] for r in top})).select(F.col("id").alias("content_chunk_id"), "file_id", "chunk_index", "chunk_text").dropDuplicates(["content_chunk_id"])
    owners = [r["file_id"] for r in text.select("file_id").distinct().collect()]  # no more than there are hits
    own = lambda c: F.col(c).isin(*(x for x in owners if x is not None))
    named = files.where(own("id")).select(F.col("id").alias("file_id"), "file_name").dropDuplicates(["file_id"])
    rows = text.join(F.broadcast(ranked), "content_chunk_id").join(named, "file_id")
    match = F.struct("rank", "content_chunk_id", "chunk_index", "similarity", "chunk_text")
    grouped = rows.groupBy("file_id", "file_name").agg(F.array_sort(F.collect_list(match)).alias("matches"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_matches"), F.max("similarity").alias("best_similarity"))
    out = grouped.withColumn("position", F.row_number().over(Window.orderBy("first")))
    if assets is not None:
        out = out.join(nested_assets(assets.where(own("file_id")).dropDuplicates(["id"])), "file_id", "left")
    return out.drop("first")


def tally(documents: DataFrame) -> DataFrame:
    """total_documents and total_chunk_matches of a grouped result."""
    return documents.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("total_chunk_matches"))


def audit_row(documents: DataFrame, tenant: str, query_text: str, now) -> DataFrame:
    """The row that a search appends to its log."""
    key = F.sha2(F.concat_ws("|", F.lit(tenant), F.lit(query_text), now.cast("string")), 256)
    return tally(documents).select(key.alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(query_text).alias("query_text"), F.col("total_chunk_matches").cast("int").alias("results_count"), now.alias("created_at"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("search_parameters"))


def document_view(files: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Each file with its chunks in order and its assets, nested."""
    parts = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "token_count"))).alias("chunks"))
    own = files.select(F.col("id").alias("file_id"), "file_name", "file_size", "file_hash")
    return own.join(parts, "file_id", "left").join(nested_assets(assets), "file_id", "left")
