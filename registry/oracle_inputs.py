"""The same input shapes as SQL, for the side-by-side check."""

NOW = "TIMESTAMP '2024-07-01 00:00:00'"


def owner(c):
    return f"CASE WHEN {c} % 3 = 0 THEN 0 ELSE {c} % 16 END"


MEMORIES = f"""memories AS (
  SELECT 'mem-' || doc_id AS id, user_id, text AS content, embedding, [lang, source] AS topics,
    [source || '-' || (doc_id % 7)] AS key_facts,
    CAST((doc_id * 53) % 100 AS DOUBLE) / 100 AS importance,
    CAST((doc_id * 37) % 100 AS DOUBLE) / 100 AS base_importance,
    CASE WHEN doc_id % 4 = 0 THEN 'positive' WHEN doc_id % 4 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
    'auto_summary' AS source,
    CASE WHEN doc_id % 10 = 9 THEN 'yearly' WHEN doc_id % 10 = 8 THEN 'monthly'
         WHEN user_id = 5 THEN NULL ELSE 'daily' END AS tier,
    CAST(doc_id % 12 AS INTEGER) AS access_count,
    TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 180) * INTERVAL 1 DAY AS last_accessed,
    TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 180) * INTERVAL 1 DAY AS created_at,
    'session-' || (doc_id % 50) AS session_id, CAST(NULL AS VARCHAR[]) AS parent_ids,
    CAST(NULL AS INTEGER) AS merge_count, lang, source AS source_tag, doc_id
  FROM (SELECT d.*, e.embedding, {owner("d.doc_id")} AS user_id
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id) x)"""

PROMPTS = f"""prompts AS (
  SELECT vec_id AS query_id, {owner("vec_id")} AS user_id, embedding AS q_embedding FROM embeddings)"""

ROUNDS = f"""rounds AS (
  SELECT {owner("conv_id")} AS user_id, CAST(conv_id AS VARCHAR) AS conv_id, conv_id || '-' || turn AS round_id,
    u AS user_text, coalesce(a, '') AS assistant_text,
    TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS ts
  FROM (SELECT conv_id, turn, role, text AS u,
          CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS a
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x
  WHERE role = 'user')"""

NOTES = f"""notes AS (
  SELECT {owner("doc_id")} AS user_id, 'note' || doc_id || '.md' AS file_name,
    replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents)"""

ACCESSES = """accesses AS (
  SELECT 'mem-' || ((user_id * 31 + event_id) % 2000) AS id, ts AS hit_at FROM events)"""

REPLIES = r"""replies AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN '{"summary":"' || t || '","topics":["a","b","c","d","e","f"],"importance":0.7}'
    WHEN 1 THEN '```json' || chr(10) || '{"summary":"' || t || '","key_facts":["k"],"sentiment":"positive"}' || chr(10) || '```'
    WHEN 2 THEN 'note: "summary": "' || t || '", "importance": 0.3, "topics": ["x", "y z"]'
    WHEN 3 THEN '["' || t || '"]'
    WHEN 4 THEN '{"summary":"' || t || '","topics":null}'
    WHEN 5 THEN '{"summary":"' || t || '","importance":1.5}'
    WHEN 6 THEN '{"summary":"' || t || '","importance":"0.25"}'
    ELSE t END AS raw, t
  FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x1f"\\]', ' ', 'g') AS t FROM documents) x)"""
