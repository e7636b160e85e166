"""DuckDB SQL of the queries that SQL can express."""

_P3 = """
SELECT DISTINCT chunk_id FROM chunks
WHERE chunk_id IS NOT NULL AND length(content) > CASE
  WHEN chunk_size IS NULL OR len(chunk_size) = 0 THEN NULL
  WHEN chunk_level IS NULL OR chunk_level < 0 THEN chunk_size[1]
  WHEN chunk_level >= len(chunk_size) THEN chunk_size[-1]
  ELSE chunk_size[chunk_level + 1] END
"""



def _p5(indifference: float, preference: float) -> str:
    """Net flows by explicit comparison of all pairs of a query's hits."""
    pref = f"CASE WHEN {{d}} <= {indifference} THEN 0 WHEN {{d}} >= {preference} THEN 1 ELSE ({{d}} - {indifference}) / ({preference} - {indifference}) END"
    flow = " + ".join(f"({pref.format(d=f'(a.{c} - b.{c})')}) - ({pref.format(d=f'(b.{c} - a.{c})')})" for c in ("ps", "pr"))
    return f"""
WITH best AS (
  SELECT query_id, id, max(score) AS score, max(rerank_score) AS rerank_score FROM hits WHERE id IS NOT NULL GROUP BY ALL
), filled AS (
  SELECT query_id, id, coalesce(score, -1e300) AS s, coalesce(rerank_score, -1e300) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM best
), ranked AS (
  SELECT *, (rank() OVER (PARTITION BY query_id ORDER BY s) - 1 + 0.5 * count(*) OVER (PARTITION BY query_id, s)) / n AS ps,
            (rank() OVER (PARTITION BY query_id ORDER BY r) - 1 + 0.5 * count(*) OVER (PARTITION BY query_id, r)) / n AS pr FROM filled
), flows AS (
  SELECT a.query_id, a.id, round(CASE WHEN any_value(a.n) > 1 THEN sum({flow}) / 2 / (any_value(a.n) - 1) ELSE 0 END, 12) + 0.0 AS flow
  FROM ranked a JOIN ranked b ON a.query_id IS NOT DISTINCT FROM b.query_id GROUP BY a.query_id, a.id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flow DESC, id) AS position FROM flows
)
"""


_P5 = _p5(0.0, 1.0)

SQL: dict[str, str] = {
    "p2_nearest": """
WITH u AS (SELECT DISTINCT chunk_id AS id, content_vector::DOUBLE[] AS v FROM chunks WHERE chunk_id IS NOT NULL AND len(content_vector) = 64 AND list_inner_product(content_vector::DOUBLE[], content_vector::DOUBLE[]) > 0),
q AS (SELECT * FROM u WHERE ('0x' || substring(id, 1, 15))::BIGINT % 100 = 0),
s AS (SELECT q.id AS chunk_id, u.id AS neighbour_id, max(round(list_cosine_similarity(q.v, u.v), 7)) AS cosine FROM q JOIN u ON q.id <> u.id GROUP BY ALL)
SELECT chunk_id, neighbour_id, round(cosine, 4) AS cosine, row_number() OVER (PARTITION BY chunk_id ORDER BY cosine DESC, neighbour_id) AS position FROM s QUALIFY position <= 5""",
    "p7_checked": "SELECT spec_id, capacity, sum(coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS tokens, TRUE AS dense, TRUE AS within FROM documents, pack_specs GROUP BY spec_id, capacity",
    "p8_checked": """
WITH have AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS t FROM documents GROUP BY source)
SELECT mix_id, m.source, coalesce(t, 0) AS available_tokens, coalesce(t, 0) * max_repeat < target_share * total_tokens AS shortfall, TRUE AS met, TRUE AS within FROM mix_targets m LEFT JOIN have USING (source)
""",
    "p3_found": _P3,
    "p3_checked": _P3.replace("SELECT DISTINCT chunk_id FROM", "SELECT DISTINCT chunk_id, length(content) AS characters, TRUE AS joined, TRUE AS within, TRUE AS shared FROM"),
    "p5_found": _P5 + "SELECT query_id, id FROM placed WHERE position <= 3",
    "p5_ranking": _P5 + "SELECT query_id, id, round(flow, 6) + 0.0 AS flow, position FROM placed",
    "p5_threshold_ranking": _p5(0.05, 0.5) + "SELECT query_id, id, round(flow, 6) + 0.0 AS flow, position FROM placed",
    "p7_found": "SELECT DISTINCT spec_id, doc_id FROM documents, pack_specs WHERE coalesce(octet_length(encode(text)), 0) + 1 > capacity",
    "p8_found": """
WITH have AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1) AS t FROM documents GROUP BY source)
SELECT mix_id, m.source FROM mix_targets m LEFT JOIN have USING (source) WHERE coalesce(t, 0) * max_repeat < target_share * total_tokens
""",
}
