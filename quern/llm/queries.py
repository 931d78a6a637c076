"""Queries and SQL of this package."""

from __future__ import annotations

from quern.llm import bpe, canon, conversations, mixture, neardup, paragraphs, spans, unify

QUERIES = {
    "p1_found": canon.p1_found,
    "p1_candidates": canon.p1_candidates,
    "p1_unmatched": canon.p1_unmatched,
    "p2_found": neardup.p2_found,
    "p2_groups": neardup.p2_groups,
    "p4_found": conversations.p4_found,
    "p5_found": unify.p5_found,
    "p5_forms": unify.p5_forms,
    "p7_ids": bpe.p7_ids,
    "p8_mix": mixture.p8_mix,
    "p8_shares": mixture.p8_shares,
    "p9_found": spans.p9_found,
    "p9_share": spans.p9_share,
    "p9_clusters": spans.p9_clusters,
    "p9_paragraphs": paragraphs.p9_paragraphs,
}

#: All windows of 200 characters; a shared one covers up to the next shared one of its text, the last all of it.
_SHARED = """
    WITH w AS (SELECT doc_id, k, substr(text, k, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
    h AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
    c AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM w WHERE s IN (SELECT s FROM h))
    SELECT doc_id, sum(least(200, coalesce(following - k, 200)))::BIGINT AS shared_chars FROM c GROUP BY doc_id
"""

SQL = {
    "p4_found": r"""
        WITH m AS (
          SELECT session_id, role, content, created_at, min(id) AS message_id,
                 arg_min(tool_calls_json IS NOT NULL, id) AS calls
          FROM chat_messages WHERE session_id IS NOT NULL GROUP BY ALL),
        n AS (
          SELECT *, CASE WHEN lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) IN ('user', 'human') THEN 'user'
                         WHEN lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) IN ('assistant', 'ai', 'bot') THEN 'assistant'
                         WHEN lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) IN ('system', 'tool') THEN 'other' END AS who,
                 NOT regexp_matches(coalesce(content, ''), '[^\s\p{Z}]') AS blank
          FROM m),
        t AS (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS k
          FROM n WHERE who = 'user' OR (who = 'assistant' AND NOT calls)),
        bad AS (
          SELECT session_id FROM n WHERE who IS NULL OR created_at IS NULL
          UNION SELECT session_id FROM t WHERE blank OR who <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END
          UNION SELECT session_id FROM t GROUP BY session_id HAVING count(*) % 2 = 1)
        SELECT session_id, k::INT AS turn_no, message_id FROM t
        WHERE session_id NOT IN (SELECT session_id FROM bad) AND session_id IN (SELECT id FROM chat_sessions)
    """,
    "p9_found": _SHARED,
    "p9_clusters": """
        WITH RECURSIVE w AS (SELECT doc_id, substr(text, k, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
        h AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        l AS (SELECT DISTINCT w.doc_id AS a, h.least AS b FROM w JOIN h USING (s)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT a AS doc_id, min(b) AS cluster_id, a <> min(b) AS remove FROM r GROUP BY a
    """,
    "p9_share": f"""
        SELECT d.doc_id, coalesce(length(text), 0)::INT AS n_text_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
               coalesce(shared_chars / nullif(length(text), 0), 0) AS shared_part
        FROM documents d LEFT JOIN ({_SHARED}) USING (doc_id)
    """,
}
