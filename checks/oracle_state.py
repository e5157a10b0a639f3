"""SQL for sessions, reports, exports, archives, folders and streams."""

from __future__ import annotations

from checks.corpus import corpus_sql
from checks.oracle_enrich import ALL, RATED, severity
from checks.oracle_python import FACTS
from checks.oracle_scan import ORACLE as SCAN_SQL
from checks.oracle_scan import C_EXTENT, C_LINE, C_SRC, JS_LINE, JS_SRC, SECRET_SQL, hits_cte

ASOF = "TIMESTAMP '2024-01-30 12:00:00'"
SESSIONS = """live AS (SELECT user_id AS session_id, CASE WHEN user_id % 10 <> 0 THEN max(ts) END AS last_active, count(*) AS message_count
  FROM events WHERE event_type = 'click' GROUP BY user_id),
stored AS (SELECT user_id AS session_id, max(ts) AS last_active FROM events WHERE event_type = 'view' GROUP BY user_id)"""


def expired(ttl: int, column: str = "last_active") -> str:
    return f"({column} IS NULL OR {ASOF} - {column} > INTERVAL {ttl} SECOND)"


EVICT = f"""WITH {SESSIONS}, gone AS (SELECT session_id FROM live WHERE {expired(86400)}),
rest AS (SELECT * FROM stored WHERE session_id NOT IN (SELECT session_id FROM gone))"""


def sessionized(ttl: int) -> str:
    return f"""SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {ttl} SECOND THEN 0 ELSE 1 END AS opens FROM events)"""


SARIF = C_SRC + C_EXTENT.replace("\nSELECT", ", calls AS (SELECT", 1) + ")" + SECRET_SQL + """, found AS (
  SELECT path, CAST(line * 100 + "startColumn" AS BIGINT) AS seq, type, line, name AS message, "startLine", "startColumn", "endLine", "endColumn" FROM calls
  UNION ALL SELECT path, seq + 1000000, type, line, '', NULL, NULL, NULL, NULL FROM secrets),
results AS (SELECT *, CASE type WHEN 'Dangerous Function' THEN 'CG1005' WHEN 'Hardcoded Secret' THEN 'CG1002' ELSE 'CG9999' END AS "ruleId",
  CASE type WHEN 'Dangerous Function' THEN 'error' WHEN 'Hardcoded Secret' THEN 'error' ELSE 'warning' END AS level FROM found)"""

PER_FILE = RATED + """, counts AS (SELECT path AS filename, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
  count(*) FILTER (severity = 'Low') AS low FROM rated GROUP BY path),
store AS (SELECT *, row_number() OVER (ORDER BY batch, filename) AS id, high || '/' || medium || '/' || low AS summary,
  CASE batch WHEN 1 THEN '2024-01-01' ELSE '2024-01-02' END AS day FROM (SELECT *, CASE WHEN starts_with(filename, 'repo/src1') THEN 1 ELSE 2 END AS batch FROM counts))"""

FILE_TOTALS = """SELECT CAST(sum(n + 1) AS BIGINT) AS lines, CAST(sum(length(text) - n) AS BIGINT) AS chars,
  CAST(sum(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'token = ')))) AS BIGINT) AS token_lines
  FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS n FROM documents) WHERE """

# .py by secrets and expected syntax findings, .js and .cpp by line rules, vendor folders left out
SUMMARY = (FACTS + SECRET_SQL + ", src AS (SELECT * FROM corpus WHERE ext IN ('.js', '.cpp')), jx AS (" + " UNION ALL ".join(
    f"SELECT path, type FROM ({SCAN_SQL[name]})" for name in ("js_token_findings", "js_bound_calls", "js_template_sql")) + ")"
           + C_LINE.replace("found AS", "cfound AS") + f""", r AS (SELECT path, {severity("type")} AS severity FROM (
  SELECT path, type FROM rules UNION ALL SELECT path, type FROM secrets WHERE path LIKE '%.py'
  UNION ALL SELECT path, type FROM jx WHERE path LIKE '%.js' UNION ALL SELECT path, type FROM cfound WHERE path LIKE '%.cpp')
  WHERE path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/build/%')""")

ORACLE = {
    "sessions_expired": f"WITH {SESSIONS} SELECT session_id, {expired(3600)} AS expired, {expired(86400)} AS expired_day, FALSE AS expired_never FROM live",
    "sessions_evict": EVICT + f""" SELECT 'live' AS side, session_id FROM live WHERE session_id NOT IN (SELECT session_id FROM gone)
        UNION ALL SELECT 'stored', session_id FROM rest WHERE NOT {expired(86400)}
        UNION ALL SELECT 'removed', (SELECT count(*) FROM gone) + (SELECT count(*) FROM rest WHERE {expired(86400)})""",
    "sessions_merged": f"""WITH {SESSIONS} SELECT coalesce(l.session_id, s.session_id) AS session_id, coalesce(l.last_active, s.last_active) AS last_active,
        l.session_id IS NOT NULL AS in_memory, coalesce(l.message_count, 0) AS message_count FROM live l FULL JOIN stored s ON l.session_id = s.session_id""",
    "session_resolve": f"""WITH {SESSIONS}, f AS (SELECT c.conv_id AS session_id, c.turn, l.session_id IS NOT NULL AS is_live, s.session_id IS NOT NULL AS is_stored,
          CASE WHEN l.session_id IS NOT NULL THEN l.last_active ELSE s.last_active END AS seen
        FROM conversations c LEFT JOIN live l ON c.conv_id = l.session_id LEFT JOIN stored s ON c.conv_id = s.session_id)
        SELECT session_id, turn, CASE WHEN NOT (is_live OR is_stored) OR {expired(86400, 'seen')} THEN 'new' WHEN is_live THEN 'live' ELSE 'stored' END AS origin,
          CASE WHEN (is_live OR is_stored) AND NOT {expired(86400, 'seen')} THEN seen END AS last_active FROM f""",
    "sessions_upsert": """SELECT session_id, messages, last_active FROM (
        SELECT user_id AS session_id, value AS messages, ts AS last_active,
          row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 1 ELSE 0 END DESC, ts DESC) AS rn
        FROM events WHERE event_type IN ('view', 'click')) WHERE rn = 1""",
    "session_store": """SELECT session_id, messages, last_active FROM (
        SELECT user_id AS session_id, event_id AS messages, ts AS last_active, event_type,
          row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 1 ELSE 0 END DESC, ts DESC) AS rn
        FROM events WHERE event_type IN ('view', 'click')) WHERE rn = 1 AND NOT (event_type = 'click' AND session_id % 3 = 0)""",
    "sessions_delete": f"WITH {SESSIONS} SELECT * FROM stored WHERE session_id NOT IN (SELECT session_id FROM live WHERE message_count % 2 = 0)",
    "sessions_list": f"WITH {SESSIONS} SELECT session_id, last_active FROM live",
    "sessionize_ttl": f"SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no FROM ({sessionized(3600)})",
    "session_table": f"""SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS last_active, count(*) AS turns
        FROM ({sessionized(7200)}) GROUP BY ALL""",
    "chat_context": """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4 GROUP BY conv_id""",
    "session_turns": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id",
    "session_history": """SELECT conv_id AS session_id, turn, role, text FROM conversations
        WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING 6000 - (conv_id * 60 + max(turn)) <= 5400)""",
    "reports_append": corpus_sql(PER_FILE + " SELECT id, filename, summary FROM store"),
    "reports_recent": corpus_sql(PER_FILE + " SELECT id, filename, day, summary FROM store ORDER BY id DESC LIMIT 50"),
    "report_by_id": corpus_sql(PER_FILE + """ SELECT id, filename, '{"high":' || high || ',"medium":' || medium || ',"low":' || low || '}' AS payload FROM store WHERE id = 17"""),
    "export_nested_json": corpus_sql(ALL + """ SELECT path, part, string_agg(coalesce(CAST(line AS VARCHAR), '-') || ':' || type || ':' || snippet, chr(10) ORDER BY seq) AS issues
        FROM (SELECT *, CAST((row_number() OVER (PARTITION BY path ORDER BY seq) - 1) // 1000 AS BIGINT) AS part FROM found) GROUP BY path, part"""),
    "export_flat_json": corpus_sql(ALL + " SELECT path, path AS file, type, line, snippet FROM found"),
    "export_sarif_results": corpus_sql(SARIF + """ SELECT path, "ruleId", level, CASE message WHEN '' THEN type ELSE message END AS message,
        coalesce("startLine", line) AS "startLine", "startColumn", coalesce("endLine", line) AS "endLine", "endColumn" FROM results"""),
    "export_sarif_documents": corpus_sql(SARIF + """ SELECT path, '2.1.0' AS version, CAST(7 AS BIGINT) AS rules, count(*) AS results, arg_min("ruleId", seq) AS first_rule
        FROM (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY seq, type, line) - 1) // 1000 AS part FROM results) GROUP BY path, part"""),
    "digest_markdown": corpus_sql(ALL + """, top AS (SELECT * FROM found ORDER BY path, seq LIMIT 10)
        SELECT 0 AS section, '# Scan summary' AS text UNION ALL SELECT 1, '- **' || type || '**: ' || count(*) FROM found GROUP BY type
        UNION ALL SELECT 2, '### First findings' UNION ALL SELECT 3, '- ' || type || ' in `' || path || '`:' || coalesce(CAST(line AS VARCHAR), 'None') || ' - m  ' || chr(10)
          || '  ```' || chr(10) || '  ' || snippet || chr(10) || '  ```' FROM top"""),
    "export_run": corpus_sql(ALL + """ SELECT stage, '20240130T120000Z' AS run_ts, CASE WHEN line IS NULL THEN 'offline' ELSE 'online' END AS llm_used, count(*) AS n
        FROM found, (SELECT unnest(['enriched', 'cleaned']) AS stage) GROUP BY ALL"""),
    "expand_archives": """WITH d AS (SELECT doc_id % 5 AS k, source || '/d' || doc_id AS p, text FROM documents)
        SELECT p || '.ZIP' AS archive, 'folder/a.py' AS path, md5(text) AS digest, FALSE AS broken FROM d WHERE k = 0
        UNION ALL SELECT p || '.ZIP', 'folder/', md5(''), FALSE FROM d WHERE k = 0
        UNION ALL SELECT p || '.ZIP', 'b.js', md5('eval(x);'), FALSE FROM d WHERE k = 0
        UNION ALL SELECT p || '.tar.gz', 'in/a.py', md5(text), FALSE FROM d WHERE k = 1
        UNION ALL SELECT p || '.txt', p || '.txt', md5(text), FALSE FROM d WHERE k = 2
        UNION ALL SELECT p || '.ZIP', p || '.ZIP', NULL, TRUE FROM d WHERE k = 3
        UNION ALL SELECT p || '.tar', p || '.tar', md5(text), FALSE FROM d WHERE k = 4""",
    "decode_text": """SELECT doc_id, 'strict' AS mode, md5(text || chr(10) || '.') AS digest FROM documents WHERE doc_id % 3 <> 0
        UNION ALL SELECT doc_id, 'lossy', md5(CASE WHEN doc_id % 3 = 0 THEN chr(65533) || text || chr(65533) || '!' ELSE text || chr(13) || chr(10) || '.' END) FROM documents""",
    "scan_files": FILE_TOTALS + "doc_id % 3 < 2",
    "scan_files_flat": FILE_TOTALS + "doc_id % 3 = 0",
    "stream_findings": corpus_sql(hits_cte() + " SELECT path, seq, rule_id, issue FROM hits"),
    "stream_sessions": f"""WITH s AS (SELECT user_id, session_no, min(ts) AS started, max(ts) AS last_active, count(*) AS turns FROM ({sessionized(3600)}) GROUP BY ALL)
        SELECT user_id, started, last_active, turns FROM s WHERE last_active + INTERVAL 3600 SECOND + INTERVAL 1 MICROSECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_turns": f"""SELECT CAST(user_id AS VARCHAR) AS key, ts, min(ts) OVER (PARTITION BY user_id, session_no) AS started,
          row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS turn_no
        FROM ({sessionized(3600)}) QUALIFY ts <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE""",
    "stream_messages": f"""SELECT CAST(user_id AS VARCHAR) AS key, ts, min(ts) OVER (PARTITION BY user_id, session_no) AS started,
          row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_type, event_id || ' ' || props) AS turn_no, event_type AS role, event_id || ' ' || props AS text
        FROM ({sessionized(3600)}) QUALIFY ts <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE""",
    "stream_evict": """WITH mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS until FROM events WHERE event_type = 'click'),
        l AS (SELECT user_id, max(ts) AS last_active, count(*) AS message_count FROM events WHERE event_type = 'click' GROUP BY user_id),
        s AS (SELECT user_id, max(ts) AS last_active FROM events WHERE event_type = 'view' GROUP BY user_id),
        gone AS (SELECT user_id FROM l, mark WHERE until - last_active > INTERVAL 1 DAY)
        SELECT 'live' AS side, CAST(user_id AS VARCHAR) AS session_id, last_active, message_count FROM l WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'stored', CAST(user_id AS VARCHAR), last_active, NULL FROM s, mark WHERE user_id NOT IN (SELECT user_id FROM gone) AND until - last_active <= INTERVAL 1 DAY""",
    "summary_job": corpus_sql(SUMMARY + """,
        f AS (SELECT path, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(*) AS n FROM r GROUP BY path),
        t AS (SELECT CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low, CAST(sum(n) AS BIGINT) AS total_issues FROM f),
        top AS (SELECT path, 5 * high + 3 * medium + low AS score, n FROM f ORDER BY 2 DESC, 1 LIMIT 3)
        SELECT high, medium, low, total_issues, round((5 * high + 3 * medium + low) / (5.0 * total_issues)::DOUBLE, 9) AS score,
          CASE WHEN 10 * (5 * high + 3 * medium + low) >= 35 * total_issues THEN 'High' WHEN 10 * (5 * high + 3 * medium + low) >= 15 * total_issues THEN 'Medium' ELSE 'Low' END AS risk,
          coalesce(nullif(concat_ws(', ', CASE WHEN high > 0 THEN high || ' high-severity issue(s)' END, CASE WHEN medium > 0 THEN medium || ' medium-severity issue(s)' END,
            CASE WHEN low > 0 THEN low || ' low-severity issue(s)' END), '') || '.', 'No issues detected.') AS rationale,
          (SELECT string_agg(path || ':' || score || ':' || n, ' ' ORDER BY score DESC, path) FROM top) AS top_files FROM t"""),
}
