"""The results of ``io_queries.py`` in SQL for DuckDB."""

from __future__ import annotations

from cueframe.oracle import _FLOOR, LOG, TURNS
from cueframe.oracle import ORACLE_SQL as BASE

#: Recordings: F frames of a conversation, a frame's square, and its level among the bars.
RECORDED = f"""{TURNS}, rec AS (SELECT conv_id, sum(len(words)) AS words, CAST(sum(len(words)) * 20 AS BIGINT) AS frames FROM segments GROUP BY conv_id),
good AS (SELECT *, least(24000, greatest(240, CAST(ceil(frames / 20.0) AS BIGINT))) AS count FROM rec WHERE conv_id % 10 NOT IN (3, 4)),
edges AS (SELECT conv_id, bar, bar * frames // count AS lo, greatest(bar * frames // count + 1, (bar + 1) * frames // count) AS hi FROM (SELECT *, unnest(range(count)) AS bar FROM good) q),
heard AS (SELECT conv_id, bar, unnest(range(lo, hi)) // 20 AS w FROM edges),
loud AS (SELECT conv_id, bar, CASE WHEN w % 7 = 0 THEN 0 ELSE (conv_id * 37 + w * 101) % 199 * 150 END AS s FROM heard),
rms AS (SELECT conv_id, bar, sqrt(CAST(sum(s * s) AS DOUBLE) / count(*)) / 32768 AS rms FROM loud GROUP BY conv_id, bar),
peaked AS (SELECT *, max(rms) OVER (PARTITION BY conv_id) AS peak FROM rms)"""

#: Segments in chunks of three, of which the first and third of each come back with a tag.
CHUNKED = "said AS (SELECT conv_id AS key, turn AS idx, coalesce(text, '') AS source_text, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 % 2 = 0 THEN '[zh] ' ELSE '' END || coalesce(text, '') AS text FROM conversations)"

ORACLE_SQL: dict[str, str] = {
    "srt_written": f"SELECT conv_id, srt, strlen(srt) AS size FROM ({BASE['srt_export']}) q",
    "versions_exported": """WITH v AS (SELECT c_custkey AS version_id, c_custkey % 4 AS k, CASE WHEN c_custkey % 4 = 1
  THEN '{' || chr(10) || '  "key": ' || c_custkey || ',' || chr(10) || '  "nation": ' || c_nationkey || chr(10) || '}' ELSE c_name END AS content FROM customer)
SELECT version_id, CASE WHEN k < 3 THEN 'versions/' || version_id || ['.txt', '.json', '.bin'][k + 1] END AS name, CASE WHEN k < 3 THEN strlen(content) END AS bytes_written, CASE WHEN k < 3 THEN content END AS content,
  CASE WHEN k = 3 THEN 'only stored text, JSON and bytes are exported' END AS reason FROM v""",
    "event_lines": f"""WITH {LOG} SELECT workflow_id, string_agg(trim(sequence || ' ' || type || ' ' || coalesce('step ' || step, '')) || chr(10), '' ORDER BY sequence) AS lines FROM log GROUP BY workflow_id""",
    "cache_written": "SELECT doc_id AS key, true AS hit, strlen(coalesce(text, '')) AS content_size, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "waveform_by_file": f"""WITH {RECORDED} SELECT conv_id, bar, CASE WHEN peak <= {_FLOOR!r} OR rms <= {_FLOOR!r} THEN 0
  ELSE CAST(floor(4 + sqrt(least(1, greatest(0, (rms - {_FLOOR!r}) / greatest(peak - {_FLOOR!r}, 2.220446049250313e-16)))) * 92 + 0.5) AS BIGINT) END AS level FROM peaked""",
    "recordings_read": f"""WITH {RECORDED} SELECT conv_id, CASE WHEN ok THEN 1000 END AS rate, CASE WHEN ok THEN 1 END AS channels, CASE WHEN ok THEN frames END AS frames, CASE WHEN ok THEN frames END AS samples,
  CASE conv_id % 10 WHEN 3 THEN 'no WAVE file' WHEN 4 THEN 'not 16-bit PCM' END AS reason FROM (SELECT *, conv_id % 10 NOT IN (3, 4) AS ok FROM rec) q""",
    "byte_ranges": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN substr(h, 1, 20) END AS head, CASE WHEN n > 100 THEN substr(h, 201, 40) END AS middle, CASE WHEN n > 2000 THEN substr(h, 4001) END AS rest, CASE WHEN n > 0 THEN right(h, 14) END AS tail FROM h""",
    "events_tailed": BASE["events_sse"],
    "monitor_streamed": BASE["monitor_step_status"],
    "progress_streamed": BASE["progress_throttled"],
    "translation_resumed": f"WITH {CHUNKED} SELECT key, idx, source_text, text FROM said",
    "correction_resumed": f"WITH {CHUNKED} SELECT key, idx, text, CASE WHEN text = source_text THEN 'unchanged' ELSE 'corrected' END AS status, CAST(NULL AS VARCHAR) AS reason FROM said",
}
