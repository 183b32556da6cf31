"""The results of ``model_queries.py`` in SQL for DuckDB."""

from __future__ import annotations

from cueframe.oracle import BOUND, CURRENT, LOG, RUNS, STATUS, TASKS, TURNS, VERSIONS, _blocks, _glued
from cueframe.operators.segmentation import PROFILES

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
UNITS = TURNS + r""",
u0 AS (SELECT conv_id, turn, start_ms, end_ms, text, turn % 4 AS t, (turn % 5 = 4) AS bare, unnest(words) AS w, unnest(range(len(words))) AS k FROM segments),
u1 AS (SELECT conv_id, turn, k, CASE WHEN t = 2 AND k % 2 = 0 THEN start_ms ELSE start_ms + 350 * k END AS s,
  CASE WHEN t = 2 THEN CASE WHEN k % 2 = 0 THEN start_ms ELSE start_ms + 350 * k END ELSE start_ms + 350 * k + 300 END AS e, w AS text
  FROM u0 WHERE NOT bare AND t <> 3 AND NOT (t = 1 AND k % 3 = 0)),
u2 AS (SELECT conv_id, turn, k, s, e, text FROM u1
  UNION ALL SELECT conv_id, turn, NULL, start_ms, end_ms, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM segments g WHERE NOT EXISTS (SELECT 1 FROM u1 WHERE u1.conv_id = g.conv_id AND u1.turn = g.turn))"""
EDGES = """, lowered AS (SELECT * REPLACE (lower(name) AS name) FROM versions),
lb AS (SELECT workflow_id, name, artifact_id, version FROM lowered QUALIFY row_number() OVER (PARTITION BY workflow_id, name ORDER BY created_at DESC, artifact_id DESC, version DESC) = 1),
cur AS (SELECT artifact_id, max(version) AS version FROM versions GROUP BY 1),
e AS (SELECT DISTINCT workflow_id, ref FROM versions, (VALUES ('step0.a'), ('step1.n'), ('step9.r'), ('project.999999999'), ('plain words'), ('Step0.A'), ('own')) r(ref)),
e1 AS (SELECT workflow_id, CASE WHEN ref = 'own' THEN 'project.' || (workflow_id + 1) ELSE ref END AS ref FROM e),
inp AS (SELECT e1.workflow_id, 'next' AS step, e1.ref, 'project' AS kind, cur.artifact_id, cur.version, cur.artifact_id IS NULL AS missing FROM e1 LEFT JOIN cur ON 'project.' || cur.artifact_id = e1.ref WHERE starts_with(e1.ref, 'project.')
  UNION ALL SELECT e1.workflow_id, 'next', e1.ref, 'step', lb.artifact_id, lb.version, lb.artifact_id IS NULL FROM e1 LEFT JOIN lb ON lb.workflow_id = e1.workflow_id AND lb.name = e1.ref WHERE e1.ref IN ('step0.a', 'step1.n', 'step9.r')
  UNION ALL SELECT workflow_id, 'next', ref, 'literal', NULL, NULL, false FROM e1 WHERE ref IN ('plain words', 'Step0.A'))"""
INPUTS = VERSIONS + EDGES
ENCODED = "enc AS (SELECT event_id, ['text', 'json', 'bytes'][1 + event_id % 3] AS encoding, props FROM events)"
INDENT = "'{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}'"
FILES = "files AS (SELECT doc_id AS path, ['audio', 'text', 'image', 'video', 'subtitle'][1 + doc_id % 5] AS kind, coalesce(text, '') AS content FROM documents)"
STORED = """stored AS (SELECT p_partkey % 40 AS workflow_id, p_partkey AS place, ['video', 'subtitle', 'subtitle_segments', 'asr_transcript', 'audio', 'translation', 'note'][1 + p_size % 7] AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'Translate.' ELSE 'step.' END || p_brand AS name, p_name AS content FROM part),
whole AS (SELECT * FROM stored WHERE place % 6 > 0 AND place % 4 <> 0)"""
STEPS = "steps AS (SELECT l_orderkey AS workflow_id, 's' || (l_linenumber % 9) AS step_id, CAST(l_linenumber AS BIGINT) AS place FROM lineitem)"
SHOWN = STATUS + """, task AS (SELECT workflow_id, step, status, ['failed', 'running', 'completed', 'paused', 'queued', 'aborted', 'draft'][1 + workflow_id % 7] AS task FROM status),
shown AS (SELECT workflow_id, step, task, status, CASE WHEN task = 'failed' THEN status WHEN status = 'failed' THEN CASE task WHEN 'running' THEN 'running' WHEN 'completed' THEN 'done' ELSE 'blocked' END
  WHEN task = 'completed' AND status = 'blocked' THEN 'done' ELSE status END AS shown FROM task)"""
NOW = "TIMESTAMP '2030-01-01'"
REPLY = """reply AS (SELECT conv_id AS key, count(*) AS n, list(turn ORDER BY turn) AS turns, count(text) AS texts FROM conversations GROUP BY 1)"""


def _point(rows: str, keys: str, shown: str) -> str:
    """Keys of ``t`` that are divisible by 97, and the negatives of those with remainder 1."""
    first, *rest = keys.split(", ")
    on = " AND ".join(f"t.{k} = w.{k}" for k in keys.split(", "))
    more = "".join(f", {k}" for k in rest)
    out = ", ".join(f"t.{c}" for c in shown.split(", "))
    picked = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f"WITH {rows}, w AS (SELECT DISTINCT {keys} FROM t WHERE {first} % 97 = 0 UNION SELECT -{first}{more} FROM t WHERE {first} % 97 = 1) SELECT {picked}, {out}, t.{first} IS NOT NULL AS found FROM w LEFT JOIN t ON {on}"


ORACLE_SQL = {
    "units_fallback": f"WITH {UNITS} SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i, s AS start_ms, e AS end_ms, text, turn AS segment_index, k AS word_index FROM u2",
    "block_payload": f"""WITH {_blocks(PROFILES['default'])}, placed AS (SELECT f.conv_id, f.block, w.i, w.turn, w.i - s.first_word AS k FROM found f JOIN words w ON w.conv_id = f.conv_id AND w.i BETWEEN f.first_i AND f.last_i JOIN segments s ON s.conv_id = w.conv_id AND s.turn = w.turn),
firsts AS (SELECT conv_id, block, turn, min(i) AS i FROM placed GROUP BY 1, 2, 3), seg AS (SELECT conv_id, block, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY i) AS source_segments FROM firsts GROUP BY 1, 2)
SELECT p.conv_id, p.block, any_value(source_segments) AS source_segments, string_agg(p.turn || ':' || p.k, ',' ORDER BY p.i) AS word_refs, count(*) AS word_count FROM placed p JOIN seg USING (conv_id, block) GROUP BY 1, 2""",
    "segments_decoded": f"WITH {TURNS} SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, start_ms, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN NULL ELSE end_ms END AS end_ms, text, NOT (conv_id % 7 = 0 AND turn = 1) AS valid FROM segments",
    "segments_invalid": f"WITH {TURNS} SELECT conv_id AS key, count(*) AS missing FROM segments WHERE conv_id % 7 = 0 AND turn = 1 GROUP BY 1",
    "segments_recognised": f"WITH {TURNS} SELECT conv_id AS key, turn AS idx, start_ms / 1000.0 AS start, end_ms / 1000.0 AS \"end\", {_STRIP.format('text')} AS text, CAST(-0.5 AS DOUBLE) AS confidence FROM segments",
    "run_texts": f"WITH {TURNS} SELECT conv_id, turn, trim(list_reduce(words, lambda a, x: {_glued('a', 'x')})) AS text FROM segments",
    "lineage_inputs": f"WITH {INPUTS} SELECT * FROM inp",
    "lineage_unresolved": f"WITH {INPUTS} SELECT workflow_id, step, ref FROM inp WHERE missing",
    "plugin_inputs": f"""WITH {INPUTS} SELECT i.workflow_id, i.step, i.ref, i.artifact_id, i.version, CASE WHEN i.artifact_id % 3 = 0 THEN '/store/' || i.artifact_id END AS file_path,
CASE WHEN i.artifact_id % 3 <> 0 THEN CAST(v.content AS VARCHAR) END AS content, CASE WHEN i.kind = 'literal' THEN i.ref END AS literal FROM inp i LEFT JOIN versions v ON v.artifact_id = i.artifact_id AND v.version = i.version WHERE NOT i.missing""",
    "selector_kinds": f"""WITH {VERSIONS}, r AS (SELECT DISTINCT unnest([name, lower(name), 'project.' || lower(name), 'a.b.c', 'x_1.y-2']) AS ref FROM versions)
SELECT ref, CASE WHEN starts_with(ref, 'project.') THEN 'project' WHEN regexp_full_match(ref, '[a-z0-9_-]+\\.[a-z0-9_-]+') THEN 'step' ELSE 'literal' END AS kind FROM r""",
    "typed_content": f"WITH {ENCODED} SELECT event_id, CASE WHEN encoding <> 'bytes' THEN props END AS text, CASE WHEN encoding = 'json' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN encoding = 'bytes' THEN strlen(props) END AS bytes FROM enc",
    "content_text": f"WITH {ENCODED} SELECT event_id, CASE encoding WHEN 'json' THEN {INDENT} WHEN 'text' THEN props END AS text FROM enc",
    "diff_text": f"WITH {ENCODED} SELECT event_id, CASE encoding WHEN 'json' THEN {INDENT} || chr(10) WHEN 'text' THEN props || chr(10) END AS text FROM enc",
    "artifact_import": f"WITH {FILES} SELECT path, kind, strlen(content) AS content_size, sha256(content) AS content_hash FROM files WHERE kind IN ('audio', 'image', 'video')",
    "artifact_import_refused": f"WITH {FILES} SELECT path, kind FROM files WHERE kind IN ('text', 'subtitle')",
    "cache_probe": f"WITH {FILES} SELECT path AS key, path % 7 > 0 AND (path % 3 = 2 OR (path % 3 = 1 AND content = reverse(content))) AS hit FROM files",
    "string_metadata": "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS url, CAST(NULL AS VARCHAR) AS duration FROM pages",
    "correction_replies": f"""WITH {REPLY}, p AS (SELECT key, n, CASE WHEN key % 19 = 0 THEN 'not an array' WHEN key % 23 = 0 THEN 'count' WHEN key % 11 = 0 OR turns <> range(n) THEN 'index' WHEN key % 13 = 0 OR texts < n THEN 'text' WHEN key % 17 = 0 THEN 'status' END AS problem FROM reply)
SELECT key, CASE WHEN problem IS NULL THEN n ELSE {{null_size}} END AS n, problem FROM p""".replace("{null_size}", "NULL"),
    "provider_models": """WITH m AS (SELECT p_brand AS provider, p_type AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_size END AS context FROM part)
SELECT provider, place, id, label, context FROM m QUALIFY row_number() OVER (PARTITION BY provider, id ORDER BY place) = 1""",
    "typed_records": "SELECT event_id, CASE WHEN event_id % 9 > 0 AND event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 9 > 0 AND event_id % 5 > 0 AND json_extract_string(props, '$.k') IS NOT NULL AS valid FROM events",
    "download_reports": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 50 > 0 THEN round_even(least(99.0, 100 * (value / (event_id % 50))), 6) END WHEN 1 THEN 100.0 END AS percent FROM events",
    "point_runs": _point(f"{RUNS}, t AS (SELECT * FROM runs)", "run_id", "workflow_id, status"),
    "point_states": _point(f"{LOG}, t AS (SELECT DISTINCT workflow_id, ['completed', 'running', 'queued', 'failed'][1 + workflow_id % 4] AS run_status FROM log)", "workflow_id", "run_status"),
    "point_step_runs": _point(f"{STATUS}, t AS (SELECT workflow_id, CAST(step AS INT) AS step, status FROM status)", "workflow_id, step", "status"),
    "point_artifacts": _point(f"{CURRENT}, t AS (SELECT * FROM now)", "artifact_id", "name, content"),
    "point_versions": _point(f"{VERSIONS}, t AS (SELECT * FROM versions)", "artifact_id, version", "name, content"),
    "point_tasks": _point(f"{TASKS}, t AS (SELECT * FROM tasks)", "run_id", "cache_key, status"),
    "tasks_newest_first": f"WITH {TASKS} SELECT * FROM tasks ORDER BY updated_at DESC, run_id DESC",
    "terminal_runs": f"WITH {RUNS} SELECT run_id, status FROM runs WHERE status IN ('aborted', 'completed', 'failed')",
    "runs_recovered": f"WITH {RUNS} SELECT run_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status FROM runs",
    "run_sync": f"""WITH {RUNS}, {LOG}, l AS (SELECT workflow_id, max(sequence) AS latest FROM log GROUP BY 1)
SELECT r.run_id, r.workflow_id, CASE WHEN latest IS NULL THEN 'pending' ELSE ['completed', 'running', 'queued', 'failed'][1 + r.workflow_id % 4] END AS status, CASE WHEN latest IS NOT NULL AND r.workflow_id % 4 IN (0, 3) THEN {NOW} END AS completed_at, coalesce(latest, 0) AS latest_event_sequence FROM runs r LEFT JOIN l ON l.workflow_id = r.workflow_id""",
    "run_failures": f"""WITH {RUNS}, {LOG}, l AS (SELECT workflow_id, max(sequence) AS latest FROM log GROUP BY 1)
SELECT run_id, 'failed' AS status, {NOW} AS completed_at, coalesce(latest, 0) AS latest_event_sequence, 'lost' AS error_code, 'run ' || run_id AS error_message FROM runs r LEFT JOIN l ON l.workflow_id = r.workflow_id WHERE status = 'running'""",
    "task_records": f"""WITH {RUNS}, {TASKS} SELECT r.run_id, CASE WHEN r.run_id % 3 = 0 THEN 't' ELSE 'task_' END || r.run_id AS task_id, 'u' || r.workflow_id AS source_uri, CASE WHEN r.run_id % 5 > 0 THEN r.status ELSE 'queued' END AS status,
CASE WHEN r.run_id % 3 = 0 THEN t.updated_at ELSE {NOW} END AS created_at, {NOW} AS updated_at FROM runs r JOIN tasks t ON t.run_id = r.run_id WHERE r.run_id % 2 = 0""",
    "task_summaries": f"WITH {TASKS} SELECT run_id AS id, CASE WHEN run_id % 2 = 0 THEN 's' ELSE '' END || cache_key AS title, status FROM tasks",
    "workflow_summaries": f"""WITH {LOG}, s AS (SELECT workflow_id, string_agg('s' || step, ',' ORDER BY step) AS steps FROM (SELECT DISTINCT workflow_id, step FROM log WHERE step IS NOT NULL) q GROUP BY 1), l AS (SELECT workflow_id, max(sequence) AS latest FROM log GROUP BY 1)
SELECT c_custkey AS workflow_id, coalesce(steps, '') AS steps, CASE WHEN l.latest IS NULL THEN 'pending' ELSE ['completed', 'running', 'queued', 'failed'][1 + c_custkey % 4] END AS state, coalesce(latest, 0) AS latest FROM customer LEFT JOIN s ON s.workflow_id = c_custkey LEFT JOIN l ON l.workflow_id = c_custkey""",
    "project_info": "SELECT n_nationkey AS project_id, n_name AS name, count(DISTINCT c_custkey) AS workflow_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 6 > 0 GROUP BY 1, 2",
    "run_project": "SELECT run_id, project_id FROM (SELECT l_orderkey AS run_id, l_suppkey % 25 AS project_id FROM lineitem WHERE l_orderkey % 3 = 0) q QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY project_id * 7 % 25, project_id) = 1",
    "artifact_roles": f"""WITH {STORED} SELECT place, concat_ws(',', CASE WHEN kind LIKE '%subtitle%' OR kind LIKE '%translation%' OR lower(name) LIKE '%segment%' OR kind LIKE '%segment%' OR lower(name) LIKE '%translation%' THEN 'segment' END,
CASE WHEN kind IN ('subtitle_segments', 'asr_transcript') THEN 'source' END, CASE WHEN kind = 'translation' OR name LIKE 'Translate.%' THEN 'translation' END, CASE WHEN kind = 'subtitle' THEN 'subtitle' END,
CASE WHEN kind = 'video' THEN 'video' END, CASE WHEN kind = 'audio' THEN 'audio' END) AS roles FROM stored""",
    "first_previews": f"WITH {STORED} SELECT workflow_id, min(place) AS version_id, arg_min(content, place) AS content FROM whole WHERE kind = 'translation' OR name LIKE 'Translate.%' GROUP BY 1",
    "subtitle_previews": f"WITH {STORED} SELECT workflow_id, min(place) AS version_id, arg_min(content, place) AS content FROM whole WHERE kind = 'subtitle' GROUP BY 1",
    "remote_titles": """WITH v AS (SELECT p_partkey % 40 AS w, p_partkey AS place, CASE WHEN p_size % 3 > 0 THEN p_brand END AS url, p_name AS title FROM part WHERE p_partkey % 4 > 0),
t AS (SELECT s_suppkey AS run_id, s_suppkey % 40 AS w, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Brand#' || (11 + s_suppkey % 5) END AS uri FROM supplier)
SELECT run_id, arg_min(trim(title), place) AS title FROM t JOIN v USING (w) WHERE url IS NULL OR uri = '' OR url = uri GROUP BY 1""",
    "tool_bindings": """WITH p AS (SELECT p_partkey % 300 AS tool, p_brand AS input, ['k' || (p_size % 9), 'k' || (p_size % 11)] AS kinds, p_partkey % 2 = 0 AS required FROM part),
t AS (SELECT tool, input, arg_min(kinds, (kinds, required)) AS kinds, bool_and(required) AS required FROM p GROUP BY 1, 2),
o AS (SELECT n_nationkey // 2 AS sp, n_nationkey % 2 AS place, 's' || (n_nationkey // 2) || '.' || lower(n_name) AS ref, 'k' || (n_nationkey % 7) AS kind FROM nation WHERE n_nationkey < 12),
b AS (SELECT tool, input, required, (SELECT ref FROM o WHERE list_contains(t.kinds, o.kind) ORDER BY sp DESC, place LIMIT 1) AS binding FROM t)
SELECT tool, input, binding FROM b WHERE binding IS NOT NULL AND tool NOT IN (SELECT tool FROM b WHERE required AND binding IS NULL)""",
    "autosave_status": "SELECT conv_id AS key, CASE WHEN bool_or(turn = 2 AND conv_id % 5 = 0) THEN 'Autosave error' WHEN bool_or(turn = 1 AND conv_id % 3 = 0) THEN 'Saving' ELSE 'Saved' END AS status FROM conversations GROUP BY 1",
    "payload_complete": "SELECT p_partkey % 500 AS key, count(DISTINCT CASE WHEN p_brand[7:7] IN ('1', '2', '3') THEN p_brand[7:7] END) = 3 AS complete FROM part GROUP BY 1",
    "artifact_counts": f"WITH {BOUND} SELECT workflow_id, count(*) AS artifact_count FROM bound GROUP BY 1",
    "tool_catalog": "SELECT p_brand || '.' || p_partkey AS ref, CAST(p_size % 4 AS INT) AS outputs FROM part WHERE p_size % 4 > 0 ORDER BY 1",
    "step_reorder": f"WITH {STEPS} SELECT workflow_id, step_id, row_number() OVER (PARTITION BY workflow_id ORDER BY CASE step_id WHEN 's5' THEN 0 WHEN 's2' THEN 1 ELSE 2 END, place) - 1 AS \"at\" FROM steps",
    "default_model_first": "SELECT s_nationkey AS provider, s_suppkey AS model, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey <> s_nationkey + 50, s_suppkey) - 1 AS \"at\" FROM supplier",
    "extra_steps": f"WITH {STEPS} SELECT CASE WHEN workflow_id % 2 = 0 THEN 'remote' ELSE 'local' END AS kind, step_id, workflow_id, true AS enabled FROM steps WHERE place <> 4 AND step_id <> 's2' AND NOT (workflow_id % 2 = 0 AND step_id = 's1')",
    "progress_shown": f"WITH {SHOWN} SELECT workflow_id, CAST(step AS INT) AS step, shown FROM shown",
    "progress_summary": f"""WITH {SHOWN}, g AS (SELECT workflow_id, task, min(step) FILTER (shown = 'failed') AS f, min(step) FILTER (shown = 'running') AS r, max(step) FILTER (shown = 'done') AS d, bool_or(status IN ('failed', 'blocked')) AS open FROM shown GROUP BY 1, 2)
SELECT workflow_id, CASE task WHEN 'failed' THEN coalesce('step ' || f || ' failed', 'Task failed') WHEN 'running' THEN coalesce('step ' || r || ' running', 'Task running') WHEN 'completed' THEN coalesce(CASE WHEN NOT open THEN 'step ' || d || ' completed' END, 'Task completed')
WHEN 'paused' THEN 'Task paused' WHEN 'aborted' THEN 'Task aborted' WHEN 'queued' THEN 'Waiting to start' ELSE 'No active step' END AS summary FROM g""",
    "plugin_events": "SELECT conv_id AS workflow_id, turn AS ts, turn AS event_id, 'plugin.event' AS type, replace(replace(text, 'que', '***'), 'the', '***') AS message FROM conversations",
    "segment_progress": f"WITH {TURNS} SELECT conv_id, turn, round_even(least(1.0, greatest(0.0, ((start_ms + end_ms) / 2.0 + (conv_id % 5 - 2) * 300 - start_ms) / greatest(1, end_ms - start_ms))), 6) AS part FROM segments",
    "placeholder_waveform": "SELECT n_nationkey AS key, b AS bar, CAST([24, 40, 62, 48, 72, 56, 80, 34][1 + b % 8] AS BIGINT) AS level FROM nation, range(48) r(b)",
    "visible_bars": f"""WITH {TURNS}, v AS (SELECT conv_id * 1000 + turn AS key, start_ms AS l, end_ms + 100 AS px, (end_ms + 100) // 4 AS bars FROM segments), w AS (SELECT key, CAST(floor(greatest(0, l - 218) / 4.0) AS BIGINT) AS a, least(bars, CAST(ceil(least(px, l + 900 - 18 + 200) / 4.0) AS BIGINT)) AS b FROM v)
SELECT key, a AS first, greatest(a, b) AS past FROM w""",
    "retry_next": "SELECT conv_id, turn, coalesce(turn < 5 AND turn % 4 <> 0 AND (conv_id % 9 = 0 OR contains(lower(text), 'que') OR contains(lower(text), 'the')), false) AS again FROM conversations",
    "hotwords": f"WITH {TURNS} SELECT conv_id, turn, nullif(array_to_string(list_filter(words, lambda w: length(w) > 4), ', '), '') AS hotwords FROM segments",
    "step_lines": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'input' END || ' -> ' || CASE WHEN p_partkey % 4 > 0 THEN replace(p_name, '_', ' ') ELSE 'output' END AS line FROM part",
    "tool_titles": """SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || CASE WHEN p_partkey % 5 = 0 THEN ' QA' ELSE '' END AS title FROM part""",
    "progress_lines": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id / 1000000.0 WHEN 1 THEN 0.0 WHEN 2 THEN 3602.5 + 60 * (event_id % 60) END AS seconds FROM events",
    "clock_times": "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END AS time, CAST(floor(CASE WHEN event_id % 2 = 0 THEN value ELSE value * 1000 END + 0.5) AS BIGINT) AS ms FROM events",
    "probed_durations": "SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 1000 + 0.5 END AS DOUBLE) AS seconds FROM events",
    "language_codes": "SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' ELSE lower(lang) END AS code FROM documents",
}
