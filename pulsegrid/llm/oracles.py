"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {
    # rows are told apart by their number, as repeated ones meet each other; doubles hold these scores exactly
    "op4_exact_top_k": """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) x FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT q.n, q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n AND len(c.x) = len(q.x)),
 r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) k FROM s)
 SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op5_warc_revisits": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) d FROM pages), m AS (SELECT d, max(page_id) last FROM p WHERE n >= 1000 GROUP BY d)
 SELECT page_id, CAST(n AS BIGINT) payload_bytes, d payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN last <> page_id THEN last END refers_to, CAST(NULL AS VARCHAR) gap FROM p LEFT JOIN m USING (d)""",
}
