"""SQL for enrichment, references, responses and roll-ups."""

from __future__ import annotations

from checks.corpus import corpus_sql, values
from checks.oracle_scan import LOCATED, SECRET_SQL, STRIP, hits_cte
from riskloom import dims
from riskloom.operators.file_rules import RULES
from riskloom.operators.match_rules import SECRETS

HIGH = ["secret", "hardcoded", "password", "api key", "aws access key", "jwt", "private key", "credential", "sql", "injection", "rce",
        "deserialization", "pickle", "marshal", "yaml", "eval", "exec", "xss", "innerhtml", "document.write", "path traversal"]
MEDIUM = ["deprecated", "hash", "md5", "sha1", "sha-1", "subprocess", "shell", "os.system", "child_process", "system", "tls", "verify",
          "certificate", "debug", "random", "format string", "printf", "tempfile", "mktemp", "dangerous", "insecure", "suspicious"]
LOW = ["regex", "assert", "import"]


def severity(column: str) -> str:
    def tier(words):
        return " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
    return f"CASE WHEN {tier(HIGH)} THEN 'High' WHEN {tier(MEDIUM)} THEN 'Medium' WHEN {tier(LOW)} THEN 'Low' ELSE 'Medium' END"


WEIGHT = "CASE severity WHEN 'High' THEN 5 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 1 ELSE 3 END"

RATED = hits_cte() + SECRET_SQL + f""", rated AS (
  SELECT *, {severity("type")} AS severity, split_part(path, '/', 2) AS source FROM (
    SELECT path, CAST(seq AS BIGINT) AS seq, issue AS type FROM hits
    UNION ALL SELECT path, CAST(seq + 100 AS BIGINT), type FROM secrets))"""
ALL = LOCATED + SECRET_SQL + """, found AS (
  SELECT path, CAST(seq AS BIGINT) AS seq, issue AS type, CAST(line AS INTEGER) AS line, snippet FROM located
  UNION ALL SELECT path, CAST(seq + 100 AS BIGINT), type, line, snippet FROM secrets)"""

DIMS = (
    ", kb AS (SELECT * FROM " + values([(i, k, s, f, " ".join(r)) for i, (k, s, f, r) in enumerate(dims.KB)], "ord, key, summary, fix, links") + ")"
    + ", templates AS (SELECT * FROM " + values([(i, k, e, f, " ".join(r)) for i, (k, e, f, r) in enumerate(dims.TEMPLATES)], "ord, key, explanation, fix, links") + ")"
    + ", hints AS (SELECT * FROM " + values([(i, k, t) for i, (k, t) in enumerate(dims.HINTS)], "ord, key, text") + ")")

TOLD = ALL + DIMS + """, types AS (SELECT DISTINCT type FROM found),
chosen AS (
  SELECT type, arg_min(t.ord, CASE WHEN t.key = lower(type) THEN -1 ELSE t.ord END) AS ord
  FROM types LEFT JOIN templates t ON contains(lower(type), t.key) OR contains(t.key, lower(type)) GROUP BY type),
told AS (
  SELECT f.*, t.key AS template, t.explanation AS t_explanation, coalesce(t.fix, '""" + dims.GENERIC_FIX + """') AS fix,
         coalesce(t.links, '""" + dims.TOP_TEN + """') AS links, k.summary AS kb_summary, k.links AS kb_links
  FROM found f JOIN chosen c ON f.type = c.type LEFT JOIN templates t ON t.ord = c.ord LEFT JOIN kb k ON k.key = lower(f.type)),
merged AS (
  SELECT *, links || CASE WHEN kb_links IS NULL THEN '' ELSE
    coalesce(' ' || nullif(array_to_string(list_filter(string_split(kb_links, ' '), lambda x: NOT list_contains(string_split(links, ' '), x)), ' '), ''), '') END AS all_links
  FROM told)"""
# What the rules advise: only types without a template show it.
ADVICE = "advice AS (SELECT * FROM " + values(
    [(r.label, r.advice) for r in RULES] + [("Possible Hardcoded Token", SECRETS[2][4]), ("Hardcoded Secret", "")], "type, advice") + "),\n"


def explained(message: str) -> str:
    return f"coalesce(t_explanation, 'Finding ''' || type || ''': ' || {message} || ' ' || snippet)"



URL = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN replace(url, 'http', 'HTTP')
  WHEN 3 THEN 'https://localhost/x' WHEN 4 THEN url || '\\s' ELSE 'see ' || url END"""
VALID = "contains(regexp_extract(trim(u), '^https?://([^/\\s]+)', 1), '.')"
REFS = f"""WITH p AS (SELECT page_id, {URL} AS u FROM pages), v AS (SELECT page_id, trim(u) AS u, {VALID} AS ok FROM p)"""

SOURCE_RISK = RATED + """, counts AS (
  SELECT source, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
         count(*) FILTER (severity = 'Low') AS low, count(*) AS total_issues FROM rated GROUP BY source),
risk AS (SELECT *, 5 * high + 3 * medium + low AS weighted FROM counts)"""

DOCS = """, docs AS (SELECT doc_id, path FROM corpus WHERE doc_id % 7 <> 0),
rows_ AS (
  SELECT doc_id, path, CAST(0 AS INTEGER) AS file_ord, CAST(0 AS BIGINT) AS seq, 'Hardcoded Secret' AS type, CAST(3 AS INTEGER) AS line, 'a' AS snippet, 'm' AS message FROM docs WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, '<unknown>', 0, 1, 'Deprecated Hash', NULL, 'b', NULL FROM docs WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, '<unknown>', 0, 2, NULL, NULL, NULL, NULL FROM docs WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, path, 0, 0, 'Insecure Regex', 7, NULL, NULL FROM docs WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id, path, 0, 1, NULL, NULL, NULL, 'none' FROM docs WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id, 'other', 1, 0, 'Dangerous Import', NULL, NULL, NULL FROM docs WHERE doc_id % 2 = 1)"""

BACKEND = f""", answered AS (
  SELECT path, seq, type, {severity("type")} AS severity,
         CASE WHEN line IS NULL THEN {explained("message")} ELSE 'about ' || type END AS explanation,
         CASE WHEN line IS NULL THEN fix ELSE 'do better' END AS fix,
         CASE WHEN line IS NULL THEN 'offline' ELSE 'online' END AS llm_used,
         CASE WHEN line IS NULL THEN all_links ELSE 'https://example.org/a' || coalesce(' ' || kb_links, '') END AS links
  FROM (SELECT m.*, a.advice AS message FROM merged m LEFT JOIN advice a ON m.type = a.type))"""

ORACLE = {
    "severity_map": corpus_sql(RATED + f" SELECT path, seq, type, severity, CAST({WEIGHT} AS BIGINT) AS weight FROM rated"),
    "hint_lookup": corpus_sql(RATED + DIMS + f""", chosen AS (
        SELECT type, arg_min(h.text, h.ord) AS hint FROM (SELECT DISTINCT type FROM rated) LEFT JOIN hints h ON contains(lower(type), h.key) OR contains(h.key, lower(type)) GROUP BY type)
        SELECT path, seq, r.type, coalesce(hint, '{dims.HINT_DEFAULT}') AS hint FROM rated r JOIN chosen c ON r.type = c.type"""),
    "explain_template": corpus_sql(TOLD + f" SELECT path, seq, type, template, {explained(chr(39) + 'm' + chr(39))} AS explanation, fix, links FROM told"),
    "kb_lookup": corpus_sql(RATED + DIMS + """ SELECT path, seq, type, k.key AS kb_key, k.fix AS kb_fix, CAST(coalesce(len(string_split(k.links, ' ')), 0) AS BIGINT) AS n_links
        FROM rated LEFT JOIN kb k ON k.key = lower(type)"""),
    "merge_references": corpus_sql(TOLD + " SELECT path, seq, all_links AS links FROM merged"),
    "enrich_findings": corpus_sql(TOLD + f""" SELECT path, seq, type, line, snippet, {severity("type")} AS severity,
        {explained("message")} AS explanation, fix, 'offline' AS llm_used, all_links AS links FROM (SELECT m.*, a.advice AS message FROM merged m LEFT JOIN advice a ON m.type = a.type)""").replace("WITH ", "WITH " + ADVICE, 1),
    "enrich_with_backend": corpus_sql(TOLD + BACKEND + " SELECT * FROM answered").replace("WITH ", "WITH " + ADVICE, 1),
    "llm_usage": corpus_sql(ALL + " SELECT count(line) AS online, count(*) - count(line) AS offline FROM found"),
    "chat_reply": "SELECT conv_id, turn, 'Finding ''chat'': ' || text || ' ' AS reply FROM conversations WHERE role = 'user'",
    "sanitize_text": "SELECT doc_id, trim(regexp_replace(regexp_replace(' ' || text || ' ! end ', '[\\x00-\\x1f]', '', 'g'), ' +', ' ', 'g')) AS clean FROM documents",
    "valid_url": f"SELECT page_id, {VALID} AS valid, {VALID} AND NOT contains(u, '\\s') AS valid_clean FROM (SELECT page_id, {URL} AS u FROM pages)",
    "normalize_refs": REFS + """ SELECT page_id, CAST(0 AS INTEGER) AS pos, u AS url, CAST(NULL AS VARCHAR) AS description FROM v WHERE ok
        UNION ALL SELECT page_id, 1, u, 'a name' FROM v WHERE ok UNION ALL SELECT page_id, 2, u, 'text here' FROM v WHERE ok""",
    "sanitize_stats": REFS + " SELECT CAST(sum(5 - CASE WHEN ok THEN 3 ELSE 0 END) AS BIGINT) AS removed_refs, CAST(sum(CASE WHEN ok THEN 3 ELSE 0 END) AS BIGINT) AS normalized_refs FROM v",
    "parse_completions": "SELECT conv_id, turn, text AS content FROM conversations",
    "parse_explanations": """SELECT conv_id, turn, CASE k WHEN 0 THEN text WHEN 1 THEN text
          WHEN 2 THEN 'Fix: old' || chr(10) || role || ' says' || chr(10) || 'Remediation: new' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'HTTP://x.example ' || chr(10) || 'https://y.example' || chr(10)
          ELSE '[1, 2]' END AS explanation,
        CASE k WHEN 0 THEN 'f' WHEN 1 THEN 'r' WHEN 2 THEN 'Remediation: new one two' ELSE '' END AS fix,
        CASE k WHEN 0 THEN 'https://a.example/1 b' WHEN 1 THEN 'c' WHEN 2 THEN 'HTTP://x.example https://y.example' ELSE '' END AS links
        FROM (SELECT *, (conv_id + turn) % 4 AS k FROM conversations)""",
    "parse_embeddings": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * CAST(1000 AS FLOAT)) AS BIGINT) AS VARCHAR)), ' ') AS numbers FROM embeddings",
    "json_or_raw": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN event_id % 3 = 0 THEN left(props, 4) END AS raw FROM events""",
    "findings_from_json": corpus_sql(DOCS + " SELECT * FROM rows_"),
    "enrich_documents": corpus_sql(DOCS + f" SELECT doc_id, path, seq, type, {severity('type')} AS severity, 'offline' AS llm_used FROM rows_"),
    "findings_rejected": corpus_sql(" SELECT doc_id, '{\"cut' AS body, 'not JSON' AS reason FROM corpus WHERE doc_id % 7 = 0"),
    "findings_by_file": corpus_sql(DOCS + """ SELECT doc_id, path, CAST(0 AS BIGINT) AS part,
        string_agg(seq || ':' || coalesce(type, '-'), ' ' ORDER BY seq) AS issues FROM rows_ GROUP BY doc_id, path"""),
    "severity_counts": corpus_sql(SOURCE_RISK + " SELECT * FROM counts"),
    "risk_by_source": corpus_sql(SOURCE_RISK + """ SELECT source, high, medium, low, total_issues, round(CAST(weighted AS DOUBLE) / (5.0 * total_issues), 9) AS score,
        CASE WHEN 10 * weighted >= 35 * total_issues THEN 'High' WHEN 10 * weighted >= 15 * total_issues THEN 'Medium' ELSE 'Low' END AS risk,
        coalesce(nullif(concat_ws(', ', CASE WHEN high > 0 THEN high || ' high-severity issue(s)' END,
        CASE WHEN medium > 0 THEN medium || ' medium-severity issue(s)' END, CASE WHEN low > 0 THEN low || ' low-severity issue(s)' END), '') || '.', 'No issues detected.') AS rationale FROM risk"""),
    "risk_score": corpus_sql(SOURCE_RISK + " SELECT source, weighted, total_issues, round(weighted / (5.0 * total_issues), 9) AS score FROM (SELECT *, CAST(weighted AS DOUBLE) AS w FROM risk)").replace("round(weighted /", "round(w /"),
    "risk_bucket": corpus_sql(SOURCE_RISK + " SELECT source, CASE WHEN 10 * weighted >= 35 * total_issues THEN 'High' WHEN 10 * weighted >= 15 * total_issues THEN 'Medium' ELSE 'Low' END AS risk FROM risk"),
    "risk_rationale": corpus_sql(SOURCE_RISK + """ SELECT source, coalesce(nullif(concat_ws(', ', CASE WHEN high > 0 THEN high || ' high-severity issue(s)' END,
        CASE WHEN medium > 0 THEN medium || ' medium-severity issue(s)' END, CASE WHEN low > 0 THEN low || ' low-severity issue(s)' END), '') || '.', 'No issues detected.') AS rationale FROM risk"""),
    "file_scores": corpus_sql(RATED + f""" SELECT c.path, CAST(coalesce(sum({WEIGHT}) FILTER (severity IS NOT NULL), 0) AS BIGINT) AS score, count(severity) AS issues
        FROM corpus c LEFT JOIN rated r ON c.path = r.path GROUP BY c.path"""),
    "top_files": corpus_sql(RATED + f""" SELECT path, CAST(sum({WEIGHT}) AS BIGINT) AS score, count(*) AS issues FROM rated GROUP BY path ORDER BY 2 DESC, 1 LIMIT 3"""),
    "corpus_summary": corpus_sql(RATED + """, f AS (SELECT source, count(*) AS n FROM corpus GROUP BY source),
        s AS (SELECT f.source, any_value(f.n) AS total_files, count(r.type) AS total_issues, count(*) FILTER (severity = 'High') AS high,
              count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM f LEFT JOIN rated r ON r.source = f.source GROUP BY f.source)
        SELECT source, total_files, total_issues, high, medium, low FROM s
        UNION ALL SELECT NULL, CAST(sum(total_files) AS BIGINT), CAST(sum(total_issues) AS BIGINT), CAST(sum(high) AS BIGINT), CAST(sum(medium) AS BIGINT), CAST(sum(low) AS BIGINT) FROM s"""),
    "type_counts": corpus_sql(RATED + """, firsts AS (SELECT type, path, seq, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY path, seq) AS rn FROM rated)
        SELECT type, n, path AS first_path, seq AS first_seq FROM firsts WHERE rn = 1"""),
    "digest_top10": corpus_sql(ALL + " SELECT path, seq, type, line, snippet FROM found ORDER BY path, seq LIMIT 10"),
    "exclude_vendor": corpus_sql(" SELECT path FROM corpus WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', 'venv', '.venv', 'build', 'dist'])"),
    "exclude_globs": corpus_sql(""" SELECT path FROM corpus WHERE len(list_filter(string_split(path, '/'),
        lambda p: p GLOB 'f1*.py' OR p GLOB 'te?ts' OR p GLOB 'f[0-4]*.[!pj]*')) = 0"""),
}
