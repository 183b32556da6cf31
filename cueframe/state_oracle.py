"""The results of ``state_queries.py`` in SQL for DuckDB."""

from __future__ import annotations

from cueframe.oracle import VERSIONS

#: Artifacts with their first version's name and their last version.
ARTIFACTS = f"""WITH {VERSIONS}, firsts AS (SELECT artifact_id, name AS first_name FROM versions WHERE version = 1),
now AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY version DESC) = 1)"""

PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS place FROM lineitem)"

GRAPH = f"""{PLACED}, steps AS (SELECT l_orderkey AS workflow_id, place, 's' || (l_partkey % 9) AS step_id, l_quantity > 25 AS srt, l_linestatus = 'O' AS changed,
  CASE WHEN l_returnflag <> 'N' AND l_discount <> 0 THEN 's' || (l_suppkey % 9) END AS ref, l_returnflag = 'R' AS wants_srt FROM placed),
lasts AS (SELECT workflow_id, step_id AS ref, place AS meant, srt AS at_srt FROM steps QUALIFY row_number() OVER (PARTITION BY workflow_id, step_id ORDER BY place DESC) = 1),
refs AS (SELECT s.*, meant, at_srt FROM steps s LEFT JOIN lasts USING (workflow_id, ref))"""

#: Rules from the words of users: what is searched and what comes instead, in order.
RULES = """words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS w FROM conversations WHERE role = 'user'),
rules AS (SELECT w, unnest(CASE WHEN length(w) > 8 THEN [w, substr(w, 2, 6)] ELSE [w] END) AS p, unnest(CASE WHEN length(w) > 8 THEN [1, 2] ELSE [1] END) AS k FROM words)"""

ORACLE_SQL: dict[str, str] = {
    "upsert_conversations": """WITH t AS (SELECT conv_id, coalesce(turn, -1) AS last_turn, role, text FROM conversations)
SELECT conv_id, last_turn, role, text, min(last_turn) OVER (PARTITION BY conv_id) AS first_turn FROM t
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY last_turn DESC, role DESC NULLS LAST, text DESC NULLS LAST) = 1""",
    "upsert_artifacts": f"{ARTIFACTS} SELECT artifact_id, version, first_name, name, type, content FROM now JOIN firsts USING (artifact_id)",
    "upsert_lookup": f"{ARTIFACTS} SELECT artifact_id, version, name FROM now WHERE artifact_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "bindings_from_runs": f"""WITH {PLACED}, outs AS (SELECT *, unnest(CASE WHEN l_quantity > 25 THEN ['text', 'srt'] ELSE ['text'] END) AS out FROM placed WHERE l_returnflag <> 'N' AND l_linenumber < 7)
SELECT l_suppkey % 50 AS workflow_id, 's' || l_linenumber || '.' || out AS selector, l_partkey AS artifact_id, CAST(place AS BIGINT) AS version FROM outs
QUALIFY row_number() OVER (PARTITION BY l_suppkey % 50, l_linenumber, out ORDER BY l_orderkey DESC, place DESC) = 1""",
    "workflow_problems": f"""WITH {GRAPH} SELECT workflow_id, CAST(place AS INT) AS place, CAST(NULL AS VARCHAR) AS name, 'repeated step' AS problem FROM steps QUALIFY row_number() OVER (PARTITION BY workflow_id, step_id ORDER BY place) > 1
UNION ALL SELECT workflow_id, CAST(place AS INT), 'source', p FROM (SELECT *, CASE WHEN ref = step_id THEN 'self-reference' WHEN meant IS NULL THEN 'unknown step' WHEN meant > place THEN 'forward reference' WHEN wants_srt AND NOT at_srt THEN 'unknown output' END AS p FROM refs WHERE ref IS NOT NULL) q WHERE p IS NOT NULL""",
    "workflow_stale": f"""WITH RECURSIVE {GRAPH}, edges AS (SELECT workflow_id, meant AS source, place FROM refs WHERE meant < place AND ref <> step_id AND (at_srt OR NOT wants_srt)),
reach AS (SELECT workflow_id, place, 0 AS distance FROM steps WHERE changed UNION SELECT e.workflow_id, e.place, distance + 1 FROM reach r JOIN edges e ON e.workflow_id = r.workflow_id AND e.source = r.place)
SELECT workflow_id, CAST(place AS INT) AS place, CAST(min(distance) AS INT) AS distance FROM reach GROUP BY 1, 2""",
    "glossary_rewritten": f"""WITH {RULES}, listed AS (SELECT list(CASE WHEN length(w) % 2 = 0 THEN '=' ELSE '~' END || p || '|' || reverse(w) ORDER BY w, k) AS rules FROM rules)
SELECT conv_id, turn, list_reduce(list_prepend(text, coalesce(rules, [])), lambda x, y: CASE WHEN y[1] = '=' THEN replace(x, split_part(y[2:], '|', 1), split_part(y, '|', 2)) ELSE regexp_replace(x, split_part(y[2:], '|', 1), split_part(y, '|', 2), 'gi') END) AS text FROM conversations, listed""",
    "glossary_matched": f"""WITH {RULES} SELECT DISTINCT doc_id, w AS source FROM documents JOIN rules ON CASE WHEN length(w) % 2 = 0 THEN contains(text, p) ELSE contains(lower(text), p) END""",
}
