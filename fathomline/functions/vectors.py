"""Vectors as arrays of numbers, computed in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_usable(a: Column) -> Column:
    """Not null, not empty, finite throughout and not all zero."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance; null if either is unusable or the lengths differ."""
    ok = is_usable(a) & is_usable(b) & (F.size(a) == F.size(b))
    return F.when(ok, F.try_divide(dot(a, b), norm(a) * norm(b)))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def mismatch(a: Column, b: Column) -> Column:
    """Why two embeddings (structs with model_name, model_version, embedding) can't be compared, or null."""
    same = a["model_version"].eqNullSafe(b["model_version"]) & (a["model_name"] == b["model_name"])
    return (
        F.when(a["embedding"].isNull() | b["embedding"].isNull(), "missing")
        .when(~same, "model")
        .when(F.size(a["embedding"]) != F.size(b["embedding"]), "dimension")
        .when(~is_usable(a["embedding"]) | ~is_usable(b["embedding"]), "norm")
    )


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's usable vectors of that length, and the vectors as rows of length one."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)  # nulls become NaN
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    ok = np.isfinite(size) & (size > 0)
    return at[ok], x[ok] / size[ok, None]


def scored(df: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """df without the column vector, with similarity: the cosine with query of the rows whose vector is usable and as long.

    One matrix product a batch: lambda functions over arrays are interpreted number by number.
    """
    kept = [c for c in df.columns if c != vector]
    q = np.asarray(query, np.float64)
    q = q / np.sqrt(q @ q)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(vector), len(q))
            rows = batch.select(kept).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.einsum("ij,j->i", x, q))], [*kept, "similarity"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(score, f"{schema}, similarity double")


def best_of(df: DataFrame, key: str, vector: str, queries: list[tuple[object, list[float]]], k: int, keep: tuple[str, ...] = (), query_type: str = "string") -> DataFrame:
    """(query_id, key, *keep, similarity): of each batch the k best keys for each query, all ties of the k-th included.

    Blocks of queries meet a batch in one matrix product, and give one batch of hits.

    A partial top-k before any shuffle. A key that comes again in a batch counts once; one that comes again in another
    batch has the same score, so that the best k of what is left, without repeated keys, are the best k of all.
    """
    by_size: dict[int, list[tuple[object, np.ndarray]]] = {}
    for name, v in queries:
        x = np.asarray(v, np.float64)
        by_size.setdefault(len(x), []).append((name, x / np.sqrt(x @ x)))
    kept = [key, *keep]
    names = pa.int64() if query_type in ("long", "bigint") else pa.int32() if query_type in ("int", "integer") else pa.string()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimension, asked in by_size.items():
                at, x = matrix(batch.column(vector), dimension)
                if not len(at):
                    continue
                codes = batch.column(key).take(pa.array(at)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                _, first = np.unique(codes, return_index=True)
                at, x = at[first], x[first]
                ids, q = [name for name, _ in asked], np.stack([v for _, v in asked])
                height = max(1, 4_000_000 // len(x))
                for i in range(0, len(ids), height):
                    s = q[i : i + height] @ x.T
                    least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k, None] if len(x) > k else np.full((len(s), 1), -2.0)
                    # products of matrices of different shapes differ in their last bits: what is near the k-th is kept and scored alike
                    of, best = np.nonzero(s >= least - 1e-9)
                    exact = np.einsum("ij,ij->i", x[best], q[i + of])
                    rows = batch.select(kept).take(pa.array(at[best]))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + j] for j in of.tolist()], names), *rows.columns, pa.array(exact)], ["query_id", *kept, "similarity"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, vector).mapInArrow(search, f"query_id {query_type}, {types}, similarity double")
