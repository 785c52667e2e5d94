"""Queries of the general operators over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators import orphans
from fathomline.storage import new_folder, read


def _orphan_state(spark: SparkSession, root: str) -> orphans.OrphanStore:
    """A new state, advanced by three deltas: files and deletions, then all references, then the chunks that some of them wait for."""
    store = orphans.OrphanStore(spark, new_folder(spark, "orphans"))
    refs = [orphans.as_references(read(spark, root, r.table), r) for r in orphans.REFERENCES]
    store.advance(0, parents=orphans.as_parents(read(spark, root, "files"), "files"), deleted=orphans.as_deleted(read(spark, root, "deleted_keys")))
    store.advance(1, references=refs[0].unionByName(refs[1]).unionByName(refs[2]))
    store.advance(2, parents=orphans.as_parents(read(spark, root, "content_chunks"), "content_chunks"))
    return store


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.open_cases(_orphan_state(spark, root).references)


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.snapshot(_orphan_state(spark, root).references)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_KEY = "CASE WHEN regexp_full_match({0}, '[0-9a-f]{{32}}') THEN {0} END"
_BARE = "lower(regexp_replace(trim({0}), '[-{{}}]', '', 'g'))"


def _norm(c: str) -> str:
    return _KEY.format(_BARE.format(c))


_CASES = f"""
WITH refs AS (
  SELECT 'chunk_embeddings' AS ref_table, id AS row_id, 'content_chunks' AS target, content_chunk_id AS written, generated_at AS t FROM chunk_embeddings
  UNION ALL SELECT 'processing_jobs', id, 'files', file_id, created_at FROM processing_jobs
  UNION ALL SELECT 'file_assets', id, 'files', file_id, created_at FROM file_assets),
one AS (SELECT DISTINCT ref_table, row_id, target, {_norm('written')} AS k, t FROM refs WHERE written IS NOT NULL AND trim(written) <> ''),
ups AS (SELECT target, k, min(created_at) AS c FROM (SELECT 'files' AS target, {_norm('id')} AS k, created_at FROM files
  UNION ALL SELECT 'content_chunks', {_norm('id')}, created_at FROM content_chunks) WHERE k IS NOT NULL GROUP BY ALL),
downs AS (SELECT DISTINCT lower(trim(ref_table)) AS target, {_norm('key_id')} AS k FROM deleted_keys),
judged AS (SELECT o.ref_table, o.row_id,
  CASE WHEN u.k IS NOT NULL AND u.c > o.t THEN 'late' WHEN u.k IS NOT NULL THEN NULL WHEN d.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind,
  coalesce(strftime(timezone('UTC', o.t), '%Y-%m'), 'unknown') AS ref_month
  FROM one o LEFT JOIN ups u ON o.target = u.target AND o.k = u.k LEFT JOIN downs d ON o.target = d.target AND o.k = d.k)
"""

ORACLES = {
    "p5_found": _CASES + "SELECT ref_table, row_id, orphan_kind, ref_month FROM judged WHERE orphan_kind IS NOT NULL",
    "p5_report": _CASES + "SELECT ref_table, ref_month, coalesce(orphan_kind, 'none') AS orphan_kind, count(*) AS n_rows FROM judged GROUP BY ALL",
}
