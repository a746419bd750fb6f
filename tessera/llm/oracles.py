"""SQL of the operators on pairs, for tables small enough to compare all pairs that share a shingle or a label."""

_REACH = """reach AS (SELECT {id}, {id} AS r FROM nodes UNION SELECT reach.{id}, links.y FROM reach JOIN links ON links.x = reach.r),
tops AS (SELECT {id}, min(r) AS component_id FROM reach GROUP BY 1)"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.c + q.c - i)),
nodes AS (SELECT doc_id FROM documents),
{_REACH.format(id='doc_id')}
SELECT d.doc_id, coalesce(c, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN tops USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda z: z * z))) AS l FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98),
degrees AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1),
nodes AS (SELECT vec_id FROM embeddings),
{_REACH.format(id='vec_id')}
SELECT e.vec_id, label, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN degrees USING (vec_id) JOIN tops USING (vec_id)
"""
