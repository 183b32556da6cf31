"""The queries' results in SQL for DuckDB, written apart from the Spark plans."""

from __future__ import annotations

from cueframe.operators.segmentation import PROFILES, Profile

# Punctuation, as in functions/text.py, in this dialect's notation.
SENTENCE, CLAUSE = "[.!?;:。！？；：]$", "[,，、]$"
TIGHT_BEFORE, TIGHT_AFTER = "^[''.,!?;:)\\]}。，！？；：]", "[(\\[{\"]$"

TURNS = r"""t0 AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\S+') AS words FROM conversations),
t1 AS (SELECT conv_id, turn, text, words, len(words) AS n, CAST(sum(len(words)) OVER (PARTITION BY conv_id ORDER BY turn) - len(words) AS BIGINT) AS first_word FROM t0 WHERE len(words) > 0),
segments AS (SELECT conv_id, turn, first_word, words, 350 * first_word + 700 * turn AS start_ms, 350 * first_word + 700 * turn + 350 * (n - 1) + 300 AS end_ms, text FROM t1)"""
WORDS = TURNS + """,
w0 AS (SELECT conv_id, turn, first_word, unnest(words) AS word, unnest(range(len(words))) AS pos FROM segments),
words AS (SELECT conv_id, turn, first_word + pos AS i, 350 * (first_word + pos) + 700 * turn AS start_ms, 350 * (first_word + pos) + 700 * turn + 300 AS end_ms, word FROM w0)"""


def _glued(text: str, word: str) -> str:
    return f"({text} || CASE WHEN regexp_matches({word}, '{TIGHT_BEFORE}') OR regexp_matches({text}, '{TIGHT_AFTER}') THEN '' ELSE ' ' END || {word})"


def _blocks(p: Profile, span: str = "NULL") -> str:
    """CTEs up to ``found``: conv_id, block, first_i, last_i, start_ms, end_ms, text."""
    tests = [f"(x.s - a.e >= {p.pause_ms} AND a.e - a.s >= {p.min_ms})", f"regexp_matches(a.txt, '{SENTENCE}')"]
    if p.clause:
        tests.append(f"(a.e - a.s >= {p.min_ms} AND regexp_matches(a.txt, '{CLAUSE}'))")
    tests += [f"x.e - a.s > {p.max_ms}", f"length({_glued('a.txt', 'x.txt')}) > {p.most_chars}"]
    cut = f"(NOT coalesce(a.span = x.span, false) AND ({' OR '.join(tests)}))"
    out = f"""{WORDS}{"" if span == "NULL" else ", " + PROTECT},
f0 AS (SELECT conv_id, list({{'txt': word, 's': start_ms, 'e': end_ms, 'span': CAST({span} AS VARCHAR), 'cuts': [i]}} ORDER BY i) AS u FROM {"words" if span == "NULL" else "spanned"} GROUP BY conv_id),
f1 AS (SELECT conv_id, list_reduce(u, lambda a, x: CASE WHEN {cut} THEN {{'txt': x.txt, 's': x.s, 'e': x.e, 'span': x.span, 'cuts': list_concat(a.cuts, x.cuts)}}
  ELSE {{'txt': {_glued('a.txt', 'x.txt')}, 's': a.s, 'e': x.e, 'span': x.span, 'cuts': a.cuts}} END).cuts AS cuts FROM f0),
f2 AS (SELECT conv_id, unnest(cuts) AS first_i FROM f1),
f3 AS (SELECT conv_id, first_i, coalesce(lead(first_i) OVER (PARTITION BY conv_id ORDER BY first_i), 9000000000) AS next_i FROM f2),
f4 AS (SELECT f3.conv_id, f3.first_i, max(i) AS last_i, min(start_ms) AS start_ms, max(end_ms) AS end_ms, list_reduce(list(word ORDER BY i), lambda a, x: {_glued('a', 'x')}) AS text
  FROM f3 JOIN words w ON w.conv_id = f3.conv_id AND w.i >= f3.first_i AND w.i < f3.next_i GROUP BY f3.conv_id, f3.first_i)"""
    if p.merge and p.min_ms:
        both = _glued("x.txt", "x.ntxt")
        back = _glued("a.txt", "x.txt")
        keep = "'ns': x.ns, 'ne': x.ne, 'ntxt': x.ntxt"
        out += f""",
m0 AS (SELECT *, lead(end_ms) OVER o AS ne, lead(text) OVER o AS ntxt, lead(start_ms) OVER o AS ns FROM f4 WINDOW o AS (PARTITION BY conv_id ORDER BY first_i)),
m1 AS (SELECT conv_id, [{{'txt': '', 's': CAST(-1 AS BIGINT), 'e': CAST(-1 AS BIGINT), 'ns': CAST(NULL AS BIGINT), 'ne': CAST(NULL AS BIGINT), 'ntxt': CAST(NULL AS VARCHAR), 'skip': false, 'g': CAST([] AS BIGINT[])}}]
  || list({{'txt': text, 's': start_ms, 'e': end_ms, 'ns': ns, 'ne': ne, 'ntxt': ntxt, 'skip': false, 'g': [first_i]}} ORDER BY first_i) AS u FROM m0 GROUP BY conv_id),
m2 AS (SELECT conv_id, list_reduce(u, lambda a, x: CASE
  WHEN a.skip THEN {{'txt': a.txt, 's': a.s, 'e': a.e, {keep}, 'skip': false, 'g': a.g}}
  WHEN x.e - x.s >= {p.min_ms} THEN {{'txt': x.txt, 's': x.s, 'e': x.e, {keep}, 'skip': false, 'g': list_concat(a.g, x.g)}}
  WHEN x.ne IS NOT NULL AND x.ne - x.s <= {p.max_ms} AND length({both}) <= {p.most_chars} THEN {{'txt': {both}, 's': x.s, 'e': x.ne, {keep}, 'skip': true, 'g': list_concat(a.g, x.g)}}
  WHEN a.s >= 0 AND x.e - a.s <= {p.max_ms} AND length({back}) <= {p.most_chars} THEN {{'txt': {back}, 's': a.s, 'e': x.e, {keep}, 'skip': false, 'g': a.g}}
  ELSE {{'txt': x.txt, 's': x.s, 'e': x.e, {keep}, 'skip': false, 'g': list_concat(a.g, x.g)}} END).g AS g FROM m1),
m3 AS (SELECT conv_id, unnest(g) AS first_i FROM m2),
m4 AS (SELECT conv_id, first_i, coalesce(lead(first_i) OVER (PARTITION BY conv_id ORDER BY first_i), 9000000000) AS next_i FROM m3),
f5 AS (SELECT m4.conv_id, m4.first_i, max(f4.last_i) AS last_i, min(start_ms) AS start_ms, max(end_ms) AS end_ms, list_reduce(list(text ORDER BY f4.first_i), lambda a, x: {_glued('a', 'x')}) AS text
  FROM m4 JOIN f4 ON f4.conv_id = m4.conv_id AND f4.first_i >= m4.first_i AND f4.first_i < m4.next_i GROUP BY m4.conv_id, m4.first_i)"""
    else:
        out += ", f5 AS (SELECT * FROM f4)"
    return out + ", found AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_i) AS block FROM f5)"


#: Spans of the queries' two protected terms: of the first term, then the first match, that holds the word.
PROTECT = r"""n0 AS (SELECT *, lower(regexp_replace(word, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS k FROM words),
n1 AS (SELECT *, k = 'of' AND lead(k) OVER o = 'the' AS h0, k = 'de' AND lead(k) OVER o = 'la' AND lead(k, 2) OVER o = 'que' AS h1 FROM n0 WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
spanned AS (SELECT *, CASE WHEN lag(h0) OVER o THEN '0-' || (i - 1) WHEN h0 THEN '0-' || i WHEN lag(h1, 2) OVER o THEN '1-' || (i - 2) WHEN lag(h1) OVER o THEN '1-' || (i - 1) WHEN h1 THEN '1-' || i END AS span
  FROM n1 WINDOW o AS (PARTITION BY conv_id ORDER BY i))"""


def _wrapped(text: str, width: int, lines: int) -> str:
    flat = f"array_to_string(regexp_extract_all({text}, '\\S+'), ' ')"
    units = f"list_transform(regexp_extract_all({text}, '\\S+'), lambda t: {{'done': '', 'line': t, 'n': 1}})"
    fits = f"(length(a.line) + 1 + length(x.line) <= {width} OR a.n >= {lines})"
    fold = f"list_reduce({units}, lambda a, x: CASE WHEN {fits} THEN {{'done': a.done, 'line': a.line || ' ' || x.line, 'n': a.n}} ELSE {{'done': a.done || a.line || chr(10), 'line': x.line, 'n': a.n + 1}} END)"
    return f"CASE WHEN length({flat}) <= {width} THEN {flat} ELSE {fold}.done || {fold}.line END"


def _materialized(p: Profile) -> str:
    return f"""{_blocks(p)},
made AS (SELECT conv_id, block, 'seg_' || CASE WHEN block < 10000 THEN lpad(CAST(block AS VARCHAR), 4, '0') ELSE CAST(block AS VARCHAR) END AS id, start_ms, end_ms, {_wrapped('text', p.chars, p.lines)} AS text,
  last_i - first_i + 1 AS word_count, greatest(end_ms - start_ms, 1) AS duration_ms FROM found)"""


def _block_sql(p: Profile) -> str:
    return f"""WITH {_materialized(p)}
SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count,
  CASE WHEN abs(1000 * v - floor(1000 * v) - 0.5) < 1e-9 THEN 2 * floor((floor(1000 * v) + 1) / 2) / 1000 ELSE round(v, 3) END AS cps
FROM (SELECT *, length(replace(text, chr(10), '')) / (duration_ms / 1000.0) AS v FROM made) q""".replace("SELECT *, length(text) - ", "SELECT * EXCLUDE (v), length(text) - ")


def _time(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _clock(ms: str) -> str:
    return f"printf('%02d:%02d.%03d', {ms} // 60000, {ms} // 1000 % 60, {ms} % 1000)"


def _glossary(text: str) -> str:
    for word in ("que", "und", "the"):
        text = f"regexp_replace({text}, '{word}', 'QUE', 'gi')"
    return f"replace(regexp_replace({text}, '([a-z]+)tion', '\\1sion', 'gi'), 'De', 'Of')"


TRANSLATED = TURNS + """,
translated AS (SELECT conv_id AS key, turn AS idx, start_ms, end_ms, text || ' ' || turn AS source_text,
  '[zh] ' || text || ' ' || (turn + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END) || CASE WHEN conv_id % 5 = 0 THEN chr(10) || chr(10) || 'x' ELSE '' END AS text FROM segments)"""
ISSUES = TRANSLATED + r""",
q0 AS (SELECT *, list_transform(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\n\r\v\f]$', ''), chr(10)), lambda x: length(x)) AS lens, regexp_extract_all(source_text, '\d+(?:[.,:]\d+)*') AS before,
  regexp_extract_all(text, '\d+(?:[.,:]\d+)*') AS now, length(regexp_replace(text, '\s+', '', 'g')) / greatest((end_ms - start_ms) / 1000.0, 0.001) AS cps FROM translated),
q1 AS (SELECT key, idx, list_filter([
  CASE WHEN len(lens) > 2 THEN {'code': 'too_many_lines', 'detail': CAST(len(lens) AS VARCHAR)} END,
  CASE WHEN list_max(lens) > 42 THEN {'code': 'line_too_long', 'detail': CAST(list_max(lens) AS VARCHAR)} END,
  CASE WHEN cps > 20 THEN {'code': 'cps_too_high', 'detail': CAST(round_even(cps, 2) AS VARCHAR)} END,
  CASE WHEN before <> now THEN {'code': 'number_mismatch', 'detail': array_to_string(before, ',') || '|' || array_to_string(now, ',')} END,
  CASE WHEN contains(lower(source_text), 'the') AND NOT contains(lower(text), 'ing') THEN {'code': 'term_mismatch', 'detail': 'the'} END,
  CASE WHEN contains(source_text, 'La') AND NOT contains(text, 'de') THEN {'code': 'term_mismatch', 'detail': 'La'} END], lambda x: x IS NOT NULL) AS found FROM q0),
issues AS (SELECT key, idx, unnest(range(len(found))) AS place, unnest(found).code AS code, unnest(found).detail AS detail FROM q1)"""

LOG = "log AS (SELECT user_id AS workflow_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type AS type, CAST(json_extract_string(props, '$.k') AS INT) % 6 AS step, value AS percent, ts, event_id FROM events)"
VERSIONS = """versions AS (SELECT l_orderkey AS artifact_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS version,
  l_shipdate AS created_at, l_linestatus AS type, 'step' || (l_linenumber % 4) || '.' || l_returnflag AS name, l_suppkey % 50 AS workflow_id, l_partkey AS content FROM lineitem)"""
CURRENT = VERSIONS + ", now AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY version DESC) = 1)"
BOUND = VERSIONS + ", bound AS (SELECT workflow_id, name, artifact_id, version FROM versions QUALIFY row_number() OVER (PARTITION BY workflow_id, name ORDER BY created_at DESC, artifact_id DESC, version DESC) = 1)"
RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS workflow_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS started_at FROM orders)"
TASKS = "tasks AS (SELECT o_orderkey AS run_id, o_custkey || '|' || o_orderpriority AS cache_key, CASE WHEN o_orderkey % 7 = 0 THEN 'aborted' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'running' END AS status, o_orderdate AS updated_at FROM orders)"
STATUS = LOG + """, wf AS (SELECT DISTINCT workflow_id, ['completed', 'running', 'queued', 'failed'][1 + workflow_id % 4] AS run_status FROM log),
seen AS (SELECT workflow_id, list(DISTINCT step) FILTER (type = 'purchase') AS done, arg_max(step, sequence) FILTER (type = 'error') AS failed, arg_max(step, sequence) FILTER (type = 'view') AS started FROM log GROUP BY 1),
status AS (SELECT wf.workflow_id, s.step, CASE WHEN run_status = 'completed' THEN 'done' WHEN failed = s.step THEN 'failed' WHEN list_contains(done, s.step) THEN 'done'
  WHEN run_status = 'running' AND started = s.step THEN 'running' WHEN run_status = 'queued' AND s.step = 0 THEN 'running' ELSE 'blocked' END AS status FROM wf JOIN seen USING (workflow_id), range(6) s(step))"""
PROGRESS = LOG + ", progress AS (SELECT *, least(100.0, greatest(0.0, percent)) AS p FROM log WHERE type = 'click' AND step IS NOT NULL AND percent IS NOT NULL)"
LATEST = PROGRESS + ", latest AS (SELECT workflow_id, step, sequence, p AS percent FROM progress QUALIFY row_number() OVER (PARTITION BY workflow_id, step ORDER BY sequence DESC) = 1)"
REVIEW = TRANSLATED + """,
src AS (SELECT key, idx, start_ms, end_ms, source_text AS text FROM translated WHERE idx % 4 < 3),
tr AS (SELECT key, idx, start_ms + CASE WHEN key % 9 = 0 THEN 1000000 ELSE 100 END AS start_ms, end_ms, source_text, CASE WHEN key % 2 = 0 THEN '' ELSE text END AS text FROM translated WHERE idx % 3 < 2),
review AS (SELECT key, idx, coalesce(tr.start_ms, src.start_ms) AS start_ms, coalesce(tr.end_ms, src.end_ms) AS end_ms, coalesce(nullif(src.text, ''), nullif(tr.source_text, ''), nullif(tr.text, ''), '') AS source_text,
  coalesce(nullif(tr.text, ''), nullif(src.text, ''), '') AS text FROM src FULL JOIN tr USING (key, idx)),
kept AS (SELECT * FROM review WHERE end_ms >= start_ms)"""
_FLOOR = 10 ** (-45 / 20)
BARS = f"""f AS (SELECT vec_id * 64 + pos AS frame, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) q),
n AS (SELECT count(*) AS n FROM f), b AS (SELECT bar, bar * n // 240 AS lo, greatest(bar * n // 240 + 1, (bar + 1) * n // 240) AS hi FROM range(240) r(bar), n),
r AS (SELECT bar, sqrt(avg(value * value)) AS rms FROM b JOIN f ON frame >= lo AND frame < hi GROUP BY bar),
bars AS (SELECT bar, CASE WHEN max(rms) OVER () <= {_FLOOR!r} OR rms <= {_FLOOR!r} THEN 0
  ELSE CAST(floor(4 + sqrt(least(1, greatest(0, (rms - {_FLOOR!r}) / greatest(max(rms) OVER () - {_FLOOR!r}, 2.220446049250313e-16)))) * 92 + 0.5) AS BIGINT) END AS level FROM r)"""
SIZE = "CASE WHEN z <= 0 THEN NULL WHEN z < 1024 THEN printf('%.1f', CAST(z AS DOUBLE)) || 'B' WHEN z < 1048576 THEN printf('%.1f', z / 1024.0) || 'KB' WHEN z < 1073741824 THEN printf('%.1f', z / 1048576.0) || 'MB' ELSE printf('%.1f', z / 1073741824.0) || 'GB' END"

ORACLE_SQL = {
    "glossary_replace": f"SELECT conv_id, turn, {_glossary('text')} AS text FROM conversations",
    "glossary_word_counts": f"SELECT conv_id, count(*) AS segments, CAST(sum(len(regexp_extract_all({_glossary('text')}, '\\S+'))) AS BIGINT) AS words, CAST(3 AS BIGINT) AS rules FROM conversations GROUP BY conv_id",
    "glossary_matches": """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'und') OR contains(lower(text), 'the') THEN '0' END,
  CASE WHEN regexp_matches(text, '(?i)[a-z]+tion') THEN '1' END, CASE WHEN contains(text, 'De') THEN '2' END], lambda x: x IS NOT NULL), ',') AS rules FROM conversations""",
    "segment_units": f"WITH {WORDS} SELECT * FROM words",
    **{f"segment_blocks_{name}": _block_sql(p) for name, p in PROFILES.items()},
    "segment_protected_terms": f"WITH {_blocks(PROFILES['default'], 'span')} SELECT conv_id, block, first_i, last_i, text FROM found",
    "segment_short_blocks": f"WITH {_blocks(PROFILES['default'])} SELECT conv_id, count(*) AS short FROM found WHERE end_ms - start_ms < 800 GROUP BY conv_id",
    "wrap_lines": f"SELECT conv_id, turn, {_wrapped('text', 40, 3)} AS text FROM conversations",
    "srt_timecodes": f"""WITH {TURNS} SELECT conv_id, turn, {_time('start_ms')} AS start, {_time('end_ms')} AS "end", {_clock('start_ms')} || ' -> ' || {_clock('end_ms')} AS clock FROM segments""",
    "srt_export": f"WITH {_materialized(PROFILES['default'])} SELECT conv_id, string_agg(block || chr(10) || {_time('start_ms')} || ' --> ' || {_time('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY block) || chr(10) AS srt FROM made GROUP BY conv_id",
    "chunk_segments": "SELECT key, chunk, count(*) AS n, max(k % 2) AS last FROM (SELECT conv_id AS key, k, k // 2 AS chunk FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) a) b GROUP BY key, chunk",
    "transcript_duration": f"WITH {TURNS} SELECT conv_id, arg_max(end_ms, turn) AS duration_ms FROM segments GROUP BY conv_id",
    "qa_issues": f"WITH {ISSUES} SELECT * FROM issues",
    "qa_summary": f"WITH {ISSUES} SELECT code, count(*) AS issues, count(DISTINCT (key, idx)) AS segments FROM issues GROUP BY code",
    "qa_documents_numbers": r"SELECT doc_id, len(f) AS n, array_to_string(f, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '\d+(?:[.,:]\d+)*') AS f FROM documents) q WHERE len(f) > 0",
    "correction_status_counts": "SELECT key, count(*) FILTER (s = 1) AS corrected, count(*) FILTER (s = 2) AS uncertain, count(*) AS segments FROM (SELECT conv_id AS key, (turn + length(text)) % 3 AS s FROM conversations) q GROUP BY key",
    "low_confidence_words": f"""WITH {TURNS} SELECT conv_id AS key, turn AS idx, len(list_filter(words, lambda w: (length(w) * 37) % 100 < 50)) AS low_words,
  array_to_string(list_filter(words, lambda w: (length(w) * 37) % 100 < 50), ' ') AS low_text, start_ms % 100 < 50 AS below FROM segments""",
    "translate_fake": "SELECT conv_id AS key, turn AS idx, '[zh] ' || text AS text FROM conversations",
    "translate_resume": "SELECT conv_id AS key, turn AS idx, CASE WHEN turn % 2 = 0 THEN '[kept] ' ELSE '[zh] ' END || text AS text FROM conversations",
    "translation_fingerprint": "SELECT conv_id AS key, sha256('model|zh|' || string_agg(sha256(text), ',' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id",
    "artifact_versions_numbered": f"WITH {VERSIONS} SELECT artifact_id, version, name, content FROM versions",
    "artifact_current": f"WITH {CURRENT} SELECT artifact_id, version, type, name, workflow_id, content FROM now",
    "artifact_list_filtered": f"WITH {CURRENT} SELECT artifact_id, version, name FROM now WHERE workflow_id = 7 AND starts_with(name, 'step1.') AND type = 'F'",
    "artifact_latest_by_name": f"WITH {CURRENT} SELECT type, name, workflow_id, artifact_id, version FROM now QUALIFY row_number() OVER (PARTITION BY type, name, workflow_id ORDER BY created_at DESC, artifact_id DESC) = 1",
    "artifact_append": f"""WITH {VERSIONS}, new AS (SELECT DISTINCT artifact_id, created_at, content FROM versions WHERE content % 3 = 0), known AS (SELECT artifact_id, count(*) AS n FROM versions WHERE content % 3 > 0 GROUP BY 1)
SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY created_at, content) + coalesce(n, 0) AS version, content, sha256(CAST(content AS VARCHAR)) AS content_hash, CAST(strlen(CAST(content AS VARCHAR)) AS BIGINT) AS content_size
FROM new LEFT JOIN known USING (artifact_id)""",
    "artifact_preview": """WITH p AS (SELECT doc_id, text, list_sum(list_transform(range(1, least(length(text), 301) + 1), lambda k: 0)) AS z, strlen(text) > 301 AS cut FROM documents)
SELECT doc_id, CASE WHEN cut THEN text[1:(SELECT max(k) FROM range(302) r(k) WHERE strlen(p.text[1:k]) <= 301)] ELSE text END AS preview, coalesce(cut, false) AS truncated FROM p""",
    "artifact_hash": "SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS content_size FROM documents",
    "config_hash": """SELECT p_partkey, sha256('{"plugin_paths":"","version":1,"workflow":' || to_json(p_name) || ',"workflow_id":' || to_json(p_type) || '}') AS hash FROM part""",
    "cache_key": """SELECT page_id, sha256('{"kind":"remote_url","quality":"best"' || coalesce(',"url":' || to_json(url), '') || '}') AS cache_key FROM pages""",
    "lineage_bindings": f"WITH {BOUND} SELECT * FROM bound",
    "artifact_reuse_map": f"WITH {BOUND} SELECT workflow_id, name, artifact_id FROM bound",
    "events_sequenced": f"WITH {LOG} SELECT workflow_id, sequence, event_id FROM log",
    "events_appended": f"WITH {LOG} SELECT workflow_id, sequence, event_id FROM log WHERE sequence > 40",
    "events_after": f"WITH {LOG} SELECT workflow_id, sequence, type FROM log WHERE workflow_id = 7 AND sequence > 40",
    "events_latest_sequence": f"WITH {LOG} SELECT c_custkey AS workflow_id, coalesce(max(sequence), 0) AS latest FROM customer LEFT JOIN log ON workflow_id = c_custkey GROUP BY 1",
    "events_sse": f"""WITH {LOG} SELECT workflow_id, sequence, 'id: ' || sequence || chr(10) || 'event: ' || type || chr(10) || 'data: {{"sequence":' || sequence || coalesce(',"step":' || step, '') || ',"type":"' || type || '","workflow_id":' || workflow_id || '}}' || chr(10) || chr(10) AS text FROM log""",
    "monitor_step_status": f"WITH {STATUS} SELECT workflow_id, CAST(step AS INT) AS step, status FROM status",
    "monitor_counts": f"WITH {STATUS} SELECT workflow_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, CAST(floor(100.0 * count(*) FILTER (status = 'done') / count(*) + 0.5) AS BIGINT) AS percent FROM status GROUP BY 1",
    "monitor_latest_progress": f"WITH {LATEST} SELECT * FROM latest",
    "monitor_log_rows": f"""WITH {LATEST} SELECT workflow_id, sequence, 'progress' AS "row", 'step ' || step || ' ' || CAST(floor(percent + 0.5) AS BIGINT) || '%' AS text FROM latest
UNION ALL SELECT workflow_id, sequence, 'text', type FROM log l WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.workflow_id = l.workflow_id AND p.sequence = l.sequence)""",
    "progress_throttled": f"""WITH {PROGRESS}, g AS (SELECT workflow_id, step, list_reduce(list({{'p': p, 'kept': [sequence]}} ORDER BY sequence), lambda a, x: CASE WHEN (x.p IN (0, 100) AND x.p <> a.p) OR abs(x.p - a.p) >= 10 THEN {{'p': x.p, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept AS kept FROM progress GROUP BY 1, 2),
k AS (SELECT workflow_id, step, unnest(kept) AS sequence FROM g) SELECT k.workflow_id, k.step, k.sequence, p AS percent FROM k JOIN progress r ON r.workflow_id = k.workflow_id AND r.sequence = k.sequence""",
    "download_bytes": f"""WITH {LOG}, d AS (SELECT workflow_id AS key, step AS bar, sequence AS "at", CAST(floor(percent) AS BIGINT) AS b FROM log), e AS (SELECT key, bar, "at", greatest(b - coalesce(lag(b) OVER (PARTITION BY key, bar ORDER BY "at"), 0), 0) AS grown FROM d)
SELECT key, bar, "at", CAST(sum(grown) OVER (PARTITION BY key ORDER BY "at") AS BIGINT) AS total FROM e""",
    "active_runs": f"WITH {RUNS} SELECT run_id, workflow_id, status FROM runs WHERE status IN ('queued', 'running')",
    "runs_ordered": f"WITH {RUNS} SELECT * FROM runs ORDER BY started_at NULLS FIRST, run_id",
    "task_reuse": f"WITH {TASKS} SELECT cache_key, run_id, updated_at FROM tasks WHERE status <> 'aborted' AND run_id % 3 > 0 AND cache_key IN (SELECT cache_key FROM tasks WHERE run_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY updated_at DESC, run_id DESC) = 1",
    "task_sync": f"WITH {RUNS}, {TASKS} SELECT t.run_id, cache_key, coalesce(r.status, t.status) AS status, coalesce(r.status <> t.status, false) AS changed FROM tasks t LEFT JOIN (SELECT * FROM runs WHERE run_id % 3 > 0) r ON r.run_id = t.run_id",
    "workflow_state": f"WITH {LOG}, wf AS (SELECT DISTINCT workflow_id, ['completed', 'running', 'queued', 'failed'][1 + workflow_id % 4] AS s FROM log) SELECT c_custkey AS workflow_id, coalesce(s, 'pending') AS status FROM customer LEFT JOIN wf ON workflow_id = c_custkey",
    "review_segments": f"WITH {REVIEW} SELECT * FROM kept",
    "review_duration": f"WITH {REVIEW} SELECT key, greatest(max(end_ms), 1) AS duration_ms FROM kept GROUP BY key",
    "segment_at_time": f"""WITH {TURNS}, s AS (SELECT conv_id AS key, turn AS idx, start_ms + 200 AS s, end_ms + CASE WHEN turn % 3 = 0 THEN 4000 ELSE 0 END AS e FROM segments), t AS (SELECT key, unnest(range(0, max(e) + 3001, 1500)) AS t FROM s GROUP BY key)
SELECT key, t, coalesce((SELECT arg_min(idx, s) FROM s WHERE s.key = t.key AND s.s <= t.t AND t.t <= s.e), (SELECT arg_max(idx, s) FROM s WHERE s.key = t.key AND s.s <= t.t), (SELECT arg_min(idx, s) FROM s WHERE s.key = t.key)) AS idx FROM t""",
    "waveform_rms": f"WITH {BARS} SELECT bar, CAST(level AS BIGINT) AS level FROM bars",
    "waveform_pool": f"WITH {BARS} SELECT bar // 8 AS bar, round(avg(level), 6) AS level FROM bars GROUP BY bar // 8",
    "waveform_bar_count": f"WITH {TURNS} SELECT conv_id, least(24000, greatest(240, CAST(ceil(max(end_ms) / 20.0) AS BIGINT))) AS bars FROM segments GROUP BY conv_id",
    "percent_clamp": "SELECT event_id, least(100.0, greatest(0.0, value)) AS percent, CASE WHEN event_id % 200 > 0 THEN round_even(least(100.0, greatest(0.0, 100 * value / (event_id % 200))), 6) ELSE 0.0 END AS share FROM events",
    "youtube_host_filter": r"SELECT page_id, coalesce(regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '(^|\.)example\.(com|net)$'), false) AS known FROM pages",
    "format_options": f"""WITH o AS (SELECT p_name AS value, p_partkey AS place, 1 AS part, concat_ws(' - ', p_name, nullif(upper(p_brand[7:8]), ''), CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 3 > 0 THEN (p_size * 16) || 'x' || (p_size * 9) ELSE (p_size * 9) || 'p' END END,
  CASE WHEN p_partkey % 2 > 0 THEN '30fps' END, CASE WHEN p_partkey % 2 = 0 THEN 'video + audio' ELSE 'video + best audio' END, {SIZE}) AS label FROM (SELECT *, CAST(floor(p_retailprice * p_partkey) AS BIGINT) AS z FROM part) q
  UNION ALL SELECT * FROM (VALUES ('best', 0, 0, 'Best'), ('small ring', 1, 0, 'Preset')) v)
SELECT value, CAST(part AS INT) AS part, place, label FROM o QUALIFY row_number() OVER (PARTITION BY value ORDER BY part, place) = 1""",
    "union_dedup_first_wins": "SELECT name, part, place FROM (SELECT regexp_replace(lower(s_name), '^[a-z]+#0*', '') AS name, 0 AS part, s_suppkey AS place FROM supplier UNION ALL SELECT regexp_replace(lower(c_name), '^[a-z]+#0*', ''), 1, c_custkey FROM customer) q QUALIFY row_number() OVER (PARTITION BY name ORDER BY part, place) = 1",
    "runs_last_wins": f"WITH {RUNS} SELECT workflow_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY coalesce(started_at, TIMESTAMP '1970-01-01') DESC, run_id DESC) = 1",
    "model_sizes": "SELECT p_brand AS key, CASE WHEN bool_or(p_partkey = 77) THEN NULL ELSE CAST(sum(p_size) AS BIGINT) END AS size FROM part GROUP BY 1",
    "redact_messages": "SELECT conv_id, turn, replace(replace(text, 'que', '***'), 'the', '***') AS text FROM conversations",
    "request_parameters": r"""SELECT event_id, CASE WHEN regexp_matches(raw, '^-?\d+(\.\d+)?$') THEN TRY_CAST(raw AS DOUBLE) END AS number FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN CAST(value AS VARCHAR) ELSE event_type END AS raw FROM events) q""",
}
