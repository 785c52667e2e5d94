"""SQL with the same result as the queries that SQL can express, for the comparison over small tables."""

from __future__ import annotations

# Unicode White_Space in DuckDB's regular expressions.
_SP = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BARE = "lower(regexp_replace(trim({0}), '[-{{}}]', '', 'g'))"

P1_FOUND = f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC NULLS LAST, config_id DESC) AS r FROM chunking_configs),
f AS (SELECT tenant_id, CASE WHEN chunk_size > 0 AND chunk_overlap >= 0 AND chunk_overlap < chunk_size AND min_chunk_size <= chunk_size THEN chunk_size END AS size FROM c WHERE r = 1),
d AS (SELECT coalesce((SELECT size FROM f WHERE tenant_id IS NULL), 578) AS size)
SELECT DISTINCT id AS content_chunk_id FROM content_chunks LEFT JOIN f ON f.tenant_id = content_chunks.tenant_id, d
WHERE len(list_filter(regexp_split_to_array(chunk_text, '{_SP}+'), lambda w: w <> '')) > coalesce(f.size, d.size)"""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

P3_FOUND = f"""WITH t AS (SELECT id, any_value({_WORDS.format('chunk_text')}) AS w FROM content_chunks WHERE chunk_text IS NOT NULL AND id IS NOT NULL GROUP BY id),
g AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a AS chunk_a, b AS chunk_b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * shared >= x.n + y.n - shared"""

_KEY = f"CASE WHEN regexp_full_match({_BARE.format('content_chunk_id')}, '[0-9a-f]{{32}}') THEN {_BARE.format('content_chunk_id')} ELSE lower(trim(content_chunk_id)) END"

P6_FOUND = f"""WITH e AS (SELECT id, any_value({_KEY}) AS owner, any_value(model_name) AS m, any_value(model_version) AS v, any_value(embedding) AS x FROM chunk_embeddings
WHERE content_chunk_id IS NOT NULL AND id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM e a JOIN e b ON a.m IS NOT DISTINCT FROM b.m AND a.v IS NOT DISTINCT FROM b.v AND len(a.x) = len(b.x) AND a.owner <> b.owner),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS embedding_a, greatest(a, b) AS embedding_b FROM r WHERE r <= 5"""

P7_FOUND = f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, any_value({_WORDS.format('text')}) AS w FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
x AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM i WHERE len(w) >= 8)),
y AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
z AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(i, i + 8)) AS p FROM x JOIN y USING (g))
SELECT doc_id, item_id FROM z GROUP BY doc_id, item_id, n HAVING 3 * count(*) >= n"""

ORACLES = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
