"""SQL for the rule queries. Patterns are written out for RE2, apart from the library's own."""

from __future__ import annotations

from checks.corpus import corpus_sql, quote

PY, JS, C = "g IN ('py','any')", "g IN ('js','any')", "g IN ('c','any')"


def re_(pattern: str, column: str = "content") -> str:
    return f"regexp_matches({column}, {quote(pattern)})"


def in_(word: str, column: str = "content") -> str:
    return f"contains({column}, {quote(word)})"


SQL15 = " OR ".join(re_("(?i)" + p) for p in (
    [rf"""["']{v}\b.*\+""" for v in ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP")]
    + [rf"""f["'].*{v}\b.*\{{""" for v in ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP")]
    + [rf"""["']{v}\b.*\.format\s*\(""" for v in ("SELECT", "INSERT", "UPDATE", "DELETE")]
    + [r"""["']SELECT\b.*%\s*[\(s]"""]))
GATE = "(" + " OR ".join(f"contains(upper(content), '{k}')" for k in ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "MERGE")) + ")"

RULES = [
    ("E01", "Hardcoded API key detected", f"{in_('API_KEY')} OR {in_('aws_access_key_id')}"),
    ("E02", "AWS access key detected (AKIA…)", re_("AKIA[0-9A-Z]{16,}")),
    ("E03", "Hardcoded secret/token variable detected", re_(r"""(?i)\b(SECRET|TOKEN|AUTH_TOKEN|ACCESS_TOKEN|AWS_SECRET|PRIVATE_KEY|CLIENT_SECRET|SECRET_KEY|ENCRYPTION_KEY|SIGNING_KEY)\b\s*=\s*["']""")),
    ("E04", "Hardcoded JWT token detected", re_(r"eyJ[A-Za-z0-9_-]{10,}\.")),
    ("E05", "Hardcoded password detected", re_(r"""(?i)\b(password|passwd|pwd)\b\s*=\s*["']""")),
    ("E06", "Private key embedded in source code", re_(r"-----BEGIN\s+(RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----")),
    ("E07", "Possible long credential string detected", re_(r"""(?i)\b(key|secret|token|credential)\b\s*=\s*["'][A-Za-z0-9+/=_-]{32,}["']""")),
    ("E08", "Possible SQL injection", f"{GATE} AND ({SQL15})"),
    ("E09", "Possible SQL injection (template literal)", f"{GATE} AND NOT ({SQL15}) AND " + re_(r"(?i)`SELECT\b.*\$\{")),
    ("E10", "Use of eval() detected", f"{PY} AND " + re_(r"\beval\s*\(")),
    ("E11", "Use of exec() detected", f"{PY} AND " + re_(r"\bexec\s*\(")),
    ("E12", "Insecure deserialization (pickle)", f"{PY} AND " + re_(r"\bpickle\.loads?\s*\(")),
    ("E13", "Insecure YAML deserialization", f"{PY} AND {re_(r'\byaml\.load\s*\(')} AND NOT {in_('SafeLoader')} AND NOT {in_('safe_load')}"),
    ("E14", "Insecure deserialization (marshal)", f"{PY} AND " + re_(r"\bmarshal\.loads?\s*\(")),
    ("E15", "subprocess with shell=True", f"{PY} AND {in_('shell=True')}"),
    ("E16", "os.system/os.popen command execution", f"{PY} AND " + re_(r"\bos\.(system|popen)\s*\(")),
    ("E17", "Deprecated hash algorithm (MD5/SHA-1)", f"{PY} AND " + re_(r"hashlib\.(md5|sha1)\s*\(")),
    ("E18", "Insecure random used for security-sensitive value", f"{PY} AND {re_(r'\brandom\.(random|randint|choice|randrange)\s*\(')} AND " + re_("(?i)(token|secret|password|key|nonce|salt|otp)")),
    ("E19", "Assert used for access control", f"{PY} AND " + re_(r"(?i)\bassert\b.*(auth|permission|role|admin|allowed)")),
    ("E20", "TLS certificate verification disabled", f"{PY} AND " + re_(r"verify\s*=\s*False")),
    ("E21", "Debug mode enabled", f"{PY} AND ({re_(r'(?i)\bDEBUG\s*=\s*True\b')} OR {re_(r'\.run\s*\(.*debug\s*=\s*True')})"),
    ("E22", "Overly broad regex pattern", f"{PY} AND " + re_(r"""re\.(compile|search|match)\s*\(\s*['"](\.\*|\.\*\?|\^\.\*\$)['"]""")),
    ("E23", "Insecure temp file creation (mktemp)", f"{PY} AND " + re_(r"\btempfile\.mktemp\s*\(")),
    ("E24", "Potential path traversal via open()", f"{PY} AND " + re_(r"(?i)open\s*\(.*\b(request|input|argv|param|user|filename)\b")),
    ("E25", "Use of eval() in JavaScript", f"{JS} AND " + re_(r"\beval\s*\(")),
    ("E26", "Dynamic Function constructor (new Function)", f"{JS} AND " + re_(r"\bnew\s+Function\s*\(")),
    ("E27", "child_process module imported", f"{JS} AND " + re_(r"""require\s*\(\s*["']child_process["']\s*\)""")),
    ("E28", "child_process.exec() – command injection risk", f"{JS} AND {re_(r'\bexec\s*\(')} AND {in_('child_process')}"),
    ("E29", "DOM-based XSS risk (innerHTML/document.write)", f"{JS} AND ({re_(r'\binnerHTML\s*=')} OR {re_(r'\bdocument\.write\s*\(')})"),
    ("E30", "React dangerouslySetInnerHTML (XSS risk)", f"{JS} AND {in_('dangerouslySetInnerHTML')}"),
    ("E31", "Hardcoded secret in JavaScript", f"{JS} AND " + re_(r"""(?i)\b(password|api_key|secret|token)\b\s*[:=]\s*["']""")),
    *[(f"E{32 + i}", f"Dangerous C function: {fn}()", f"{C} AND " + re_(rf"\b{fn}\s*\("))
      for i, fn in enumerate(["strcpy", "strcat", "sprintf", "gets", "scanf", "system", "popen", "mktemp"])],
    ("E40", "Potential format-string vulnerability (printf with variable)", f"{C} AND " + re_(r"\bprintf\s*\(\s*[a-zA-Z_]\w*\s*\)")),
    ("E41", "Hardcoded password in C/C++ source", f"{C} AND " + re_(r'(?i)\b(password|passwd)\b.*=\s*"')),
]

ROUTE = r"""CASE WHEN regexp_matches(lower(path), '\.(py|pyw)$') THEN 'py'
  WHEN regexp_matches(lower(path), '\.(js|jsx|ts|tsx|mjs|cjs)$') THEN 'js'
  WHEN regexp_matches(lower(path), '\.(c|cpp|cc|cxx|h|hpp)$') THEN 'c' ELSE 'any' END"""


def hits_cte(source: str = "corpus", keep: str = "") -> str:
    """CTEs `routed` and `hits` over a table with path and content."""
    extra = f", {keep}" if keep else ""
    struct = ", ".join(
        f"CASE WHEN {test} THEN {{'seq': {i}, 'rule_id': {quote(rid)}, 'issue': {quote(label)}}} END"
        for i, (rid, label, test) in enumerate(RULES, 1))
    return f""", routed AS (SELECT path, content, {ROUTE} AS g{extra} FROM {source}),
hits AS (SELECT path{extra}, u.seq AS seq, u.rule_id AS rule_id, u.issue AS issue
         FROM (SELECT path{extra}, unnest([{struct}]) AS u FROM routed) WHERE u IS NOT NULL)"""


LINES = """, lines AS (
  SELECT path, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line, unnest(parts) AS text
  FROM (SELECT path, string_split(left(content, length(content) - 1), chr(10)) AS parts FROM {source}))"""

STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"

LINE_WORDS = """(contains(it, 'password') AND (contains(ln, 'password') OR contains(ln, 'passwd')))
  OR (contains(it, 'api key') AND (contains(ln, 'api_key') OR contains(ln, 'apikey')))
  OR (contains(it, 'aws') AND contains(ln, 'akia'))
  OR (contains(it, 'jwt') AND contains(ln, 'eyj'))
  OR (contains(it, 'secret') AND contains(ln, 'secret'))
  OR (contains(it, 'sql') AND (contains(ln, 'select') OR contains(ln, 'insert')))
  OR (contains(it, 'eval') AND contains(ln, 'eval'))
  OR (contains(it, 'pickle') AND contains(ln, 'pickle'))
  OR (contains(it, 'shell') AND contains(ln, 'shell'))
  OR ((contains(it, 'md5') OR contains(it, 'sha1') OR contains(it, 'sha-1')) AND (contains(ln, 'md5') OR contains(ln, 'sha1')))
  OR (contains(it, 'strcpy') AND contains(ln, 'strcpy'))
  OR (contains(it, 'system') AND contains(ln, 'system'))
  OR (contains(it, 'regex') AND contains(ln, 're.'))"""

LOCATED = hits_cte() + LINES.format(source="corpus") + f""", located AS (
  SELECT h.path, h.seq, h.rule_id, h.issue, min(l.line) AS line,
         coalesce({STRIP.format("arg_min(l.text, l.line)")}, '') AS snippet
  FROM hits h LEFT JOIN (SELECT path, line, text, lower(text) AS ln FROM lines) l
    ON h.path = l.path AND ({LINE_WORDS.replace("it,", "lower(h.issue),")})
  GROUP BY h.path, h.seq, h.rule_id, h.issue)"""

JS_SRC = ", src AS (SELECT * FROM corpus WHERE ext IN ('.js', '.ts', '.jsx'))"
C_SRC = ", src AS (SELECT * FROM corpus WHERE ext IN ('.cpp', '.c'))"


def line_rules_cte(rules) -> str:
    structs = ", ".join(f"CASE WHEN {test} THEN {{'rule': {i}, 'type': {quote(kind)}}} END" for i, (kind, test) in enumerate(rules, 1))
    return LINES.format(source="src") + f""", found AS (
  SELECT path, line, CAST(line AS BIGINT) * 10 + u.rule AS seq, u.type AS type, {STRIP.format("text")} AS snippet
  FROM (SELECT path, line, text, unnest([{structs}]) AS u FROM lines) WHERE u IS NOT NULL)"""


JS_LINE = line_rules_cte([
    ("Insecure Function Usage", re_(r"\beval\s*\(", "text")),
    ("Insecure Regex", re_(r"\b(new\s+RegExp|RegExp)\b", "text") + " AND " + in_(".*", "text")),
    ("Suspicious Subprocess Call", re_(r"\b(child_process\.|\bexec\s*\(|\.exec\()", "text")),
    ("Possible SQL Injection", re_(r"(?i)\b(select|insert|update|delete)\b", "text") + " AND (" + in_("+", "text") + " OR " + in_("${", "text") + ")"),
    ("Hardcoded Secret", re_(r"""(?i)\b(password|api_key|secret)\b\s*[:=]\s*['"]""", "text")),
])
C_LINE = line_rules_cte([
    *[("Dangerous Function", f"({re_(rf'\b{fn}\s*\(', 'text')} OR {re_(rf'{fn}.*\(', 'text')})") for fn in ("system", "popen", "exec", "strcpy", "gets", "sprintf")],
    ("Hardcoded Secret", re_(r"""(?i)\b(password|api_key|secret)\b.*=[^\n]*['"]""", "text")),
])


def context(around: int) -> str:
    parts = "string_split(left(c.content, length(c.content) - 1), chr(10))"
    window = f"{parts}[greatest(f.line - {around}, 1):least(f.line + {around}, len({parts}))]"
    return STRIP.format(f"array_to_string(list_transform({window}, lambda x: rtrim(x, ' ' || chr(9) || chr(13))), chr(10))")


SECRETS = [
    ("P11", "Hardcoded Secret", r"""(?i)\b(password|passwd|pwd)\s*=\s*(['"][^'"]{4,}['"])"""),
    ("P12", "Hardcoded Secret", r"""(?i)\b(api_key|apikey|aws_access_key_id|aws_secret_access_key)\s*=\s*(['"][^'"]{4,}['"])"""),
    ("P13", "Possible Hardcoded Token", r"""['"][A-Za-z0-9_\-]{20,}['"]"""),
]


def matches_cte(name: str, source: str, column: str, pattern: str, keep: str) -> str:
    """One row per match: keep columns, k (order), line, column, text; positions from the marked text."""
    marked = f"regexp_replace({column}, {quote(pattern)}, chr(1) || '\\0', 'g')"
    return f""", {name}_p AS (
  SELECT {keep}, string_split({marked}, chr(1)) AS pieces, regexp_extract_all({column}, {quote(pattern)}) AS texts FROM {source}),
{name}_q AS (
  SELECT {keep}, k, texts[k] AS text, array_to_string(pieces[1:k], '') AS before
  FROM (SELECT *, unnest(range(1, len(pieces))) AS k FROM {name}_p)),
{name} AS (
  SELECT {keep}, k, text, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line,
         CAST(length(before) - length(regexp_extract(before, '^(?s:.*)\\n')) + 1 AS INTEGER) AS col
  FROM {name}_q)"""


SECRET_SQL = "".join(matches_cte(r.lower(), "corpus", "content", p, "path") for r, _, p in SECRETS) + """, secrets AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY rule_id, k) AS seq, rule_id, type, line, text AS snippet
  FROM (""" + " UNION ALL ".join(f"SELECT path, k, line, text, '{r}' AS rule_id, '{t}' AS type FROM {r.lower()}" for r, t, _ in SECRETS) + "))"

TOKEN = "|".join([r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\z)", r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?",
                  r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`?", r"[^/\"'`]+", "/"])
BLANK = "regexp_replace({0}, '[^\\n]', ' ', 'g')"
CODE = f""", toks AS (SELECT *, regexp_extract_all(content, {quote(TOKEN)}) AS tokens FROM src),
code AS (SELECT path, content,
  array_to_string(list_transform(tokens, lambda t: CASE WHEN left(t, 2) IN ('//', '/*') THEN {BLANK.format("t")} ELSE t END), '') AS uncommented,
  array_to_string(list_transform(tokens, lambda t: CASE WHEN left(t, 2) IN ('//', '/*') THEN {BLANK.format("t")}
    WHEN left(t, 1) IN ('"', '''', '`') AND length(t) > 1 THEN left(t, 1) || {BLANK.format("substr(t, 2, length(t) - 2)")} || right(t, 1) ELSE t END), '') AS bare
  FROM toks)"""
LINE_AT = "string_split(c.content, chr(10))[m.line]"

JX1, JX2 = r"(?:^|[^\w$.])eval\s*\(", r"(?:^|[^\w$.])(?:child_process|require\s*\([^()]*\))\s*\.\s*exec\s*\("
JX4 = r"""\bnew\s+RegExp\s*\(\s*(?:"[^"\n]*\.\*[^"\n]*"|'[^'\n]*\.\*[^'\n]*')"""


def behind(pattern: str) -> str:
    """RE2 has no look-behind: the character before is part of the match, so a newline there counts too."""
    return f"CAST(line + CASE WHEN left(text, 1) = chr(10) THEN 1 ELSE 0 END AS INTEGER)"


JS_TOKENS = CODE + matches_cte("jx1", "code", "bare", JX1, "path") + matches_cte("jx2", "code", "bare", JX2, "path") + matches_cte("jx4", "code", "uncommented", JX4, "path") + f""", m AS (
  SELECT path, 'JX1' AS rule_id, 'Insecure Function Usage' AS type, {behind(JX1)} AS line FROM jx1
  UNION ALL SELECT path, 'JX2', 'Suspicious Subprocess Call', {behind(JX2)} FROM jx2
  UNION ALL SELECT path, 'JX4', 'Insecure Regex', line FROM jx4)
SELECT m.path, m.rule_id, m.type, m.line, {STRIP.format(LINE_AT)} AS snippet FROM m JOIN code c ON m.path = c.path"""

SITE = r"[\w$.]*(?:function )?[A-Za-z_$][\w$]*\s*\("
JS_BOUND = CODE + matches_cte("site", "code", "bare", r"(?:function )?[\w$.]*[A-Za-z_$][\w$]*\s*\(", "path") + """, names AS (
  SELECT DISTINCT path, trim(split_part(n, ':', 1)) AS name FROM (
    SELECT path, unnest(string_split(g, ',')) AS n FROM (
      SELECT path, unnest(regexp_extract_all(uncommented, '\\{([^{}]*)\\}\\s*=\\s*require\\s*\\(\\s*[''"]child_process[''"]\\s*\\)', 1)) AS g FROM code)))
SELECT m.path, 'JX3' AS rule_id, 'Suspicious Subprocess Call' AS type, m.line, n.name, """ + STRIP.format(LINE_AT) + """ AS snippet
FROM site m JOIN names n ON m.path = n.path AND regexp_replace(m.text, '\\s*\\($', '') = n.name JOIN code c ON m.path = c.path"""

JS_TEMPLATE = CODE + matches_cte("lit", "code", "uncommented", r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`?", "path") + """, pieces AS (
  SELECT path, line, k, unnest(regexp_split_to_array(text, '\\$\\{[^}]*\\}')) AS piece,
         generate_subscripts(regexp_split_to_array(text, '\\$\\{[^}]*\\}'), 1) AS j FROM lit)
SELECT m.path, CAST(row_number() OVER (PARTITION BY m.path ORDER BY m.k, m.j) AS INTEGER) AS seq, 'JX5' AS rule_id,
       'Possible SQL Injection' AS type, m.line, """ + STRIP.format(LINE_AT) + """ AS snippet
FROM pieces m JOIN code c ON m.path = c.path WHERE regexp_matches(m.piece, '(?i)select|insert|update|delete|where|from')"""

# A call's text goes on to the bracket that closes it: the first place where as many are closed as opened, character by character.
C_EXTENT = CODE + matches_cte("call", "code", "bare", r"\b(?:system|popen|exec|strcpy|gets|sprintf)\s*\(", "path") + f""", rest AS (
  SELECT f.*, substr(array_to_string(string_split(c.bare, chr(10))[f.line:], chr(10)), f.col + length(f.text)) AS rest
  FROM call f JOIN code c ON f.path = c.path), places AS (
  SELECT path, line, col, rest, unnest(range(1, length(rest) + 1)) AS k FROM rest), depths AS (
  SELECT path, line, col, k, sum(CASE substr(rest, k, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY path, line, col ORDER BY k) AS depth
  FROM places), closed AS (SELECT path, line, col, min(k) AS k FROM depths WHERE depth = -1 GROUP BY ALL), whole AS (
  SELECT r.path, r.line, r.col, r.text, r.text || coalesce(left(r.rest, e.k), '') AS extent
  FROM rest r LEFT JOIN closed e ON r.path = e.path AND r.line = e.line AND r.col = e.col)
SELECT f.path, 'Dangerous Function' AS type, f.line, regexp_extract(f.text, '^\\w+') AS name, f.line AS "startLine", f.col AS "startColumn",
       CAST(f.line + length(f.extent) - length(replace(f.extent, chr(10), '')) AS INTEGER) AS "endLine",
       CAST(CASE WHEN contains(f.extent, chr(10)) THEN length(string_split(f.extent, chr(10))[-1]) + 1 ELSE f.col + length(f.extent) END AS INTEGER) AS "endColumn",
       {context(1)} AS snippet
FROM whole f JOIN code c ON f.path = c.path"""

C_DECLS = CODE + matches_cte("decl", "code", "uncommented", r'\b[A-Za-z_]\w*[ \t*&]+[A-Za-z_]\w*[ \t]*(?:\[[^\]\n]*\])?[ \t]*=[ \t]*"[^"\n]*"', "path") + f""", d AS (
  SELECT *, regexp_extract(text, '"[^"]*"$') AS literal FROM decl)
SELECT f.path, 'Hardcoded Secret' AS type, f.line, f.line AS "startLine", CAST(f.col + instr(f.text, '"') - 1 AS INTEGER) AS "startColumn",
       f.line AS "endLine", CAST(f.col + length(f.text) AS INTEGER) AS "endColumn", f.literal, {context(1)} AS snippet
FROM d f JOIN code c ON f.path = c.path WHERE length(f.literal) > 8"""

ORACLE = {
    "lines": corpus_sql(LINES.format(source="corpus") + " SELECT path, line, text FROM lines"),
    "route_language": corpus_sql(f" SELECT path, {ROUTE} AS lang FROM corpus"),
    "engine_findings": corpus_sql(hits_cte() + " SELECT path, seq, rule_id, issue FROM hits"),
    "engine_sql_gate": corpus_sql(hits_cte() + " SELECT path, rule_id, issue FROM hits WHERE rule_id IN ('E08', 'E09')"),
    "scan_headline": corpus_sql(hits_cte() + """ SELECT c.path, coalesce(arg_min(h.issue, h.seq), 'No obvious issues found') AS issue, count(h.seq) AS n_issues
        FROM corpus c LEFT JOIN hits h ON c.path = h.path GROUP BY c.path"""),
    "engine_to_findings": corpus_sql(LOCATED + " SELECT path, seq, issue AS type, line, snippet FROM located"),
    "locate_issue_line": corpus_sql(LOCATED + " SELECT path, issue, line FROM located"),
    "dedup_issues": corpus_sql(hits_cte() + """, twice AS (SELECT path, seq, issue FROM hits UNION ALL SELECT path, seq + 100, issue FROM hits)
        SELECT path, issue, seq FROM (SELECT *, row_number() OVER (PARTITION BY path, issue ORDER BY seq) AS rn FROM twice) WHERE rn = 1"""),
    "js_line_findings": corpus_sql(JS_SRC + JS_LINE + " SELECT path, seq, type, line, snippet FROM found"),
    "cpp_line_findings": corpus_sql(C_SRC + C_LINE + " SELECT path, seq, type, line, snippet FROM found"),
    "cpp_fallback_extent": corpus_sql(C_SRC + C_LINE + f""" SELECT f.path, f.seq, f.type, f.line, f.line AS "startLine", CAST(NULL AS INTEGER) AS "startColumn",
        f.line AS "endLine", CAST(NULL AS INTEGER) AS "endColumn", {context(1)} AS snippet FROM found f JOIN corpus c ON f.path = c.path"""),
    "snippet_context": corpus_sql(C_SRC + C_LINE + f" SELECT f.path, f.seq, f.line, {context(2)} AS context FROM found f JOIN corpus c ON f.path = c.path"),
    "secret_matches": corpus_sql(SECRET_SQL + " SELECT path, seq, rule_id, type, line, snippet FROM secrets"),
    "js_token_findings": corpus_sql(JS_SRC + JS_TOKENS),
    "js_bound_calls": corpus_sql(JS_SRC + JS_BOUND),
    "js_template_sql": corpus_sql(JS_SRC + JS_TEMPLATE),
    "cpp_calls_extent": corpus_sql(C_SRC + C_EXTENT),
    "cpp_literal_decls": corpus_sql(C_SRC + C_DECLS),
    "normalize_findings": corpus_sql(LINES.format(source="corpus") + f""" SELECT path, line AS pos,
        CASE WHEN line % 3 <> 0 THEN 'Line' ELSE 'Unknown' END AS type, CASE WHEN line % 4 <> 0 THEN line END AS line,
        CASE WHEN line % 5 <> 0 THEN {STRIP.format("text")} ELSE '' END AS snippet, '' AS message FROM lines"""),
    "scan_snippets": "WITH src AS (SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'turn_' || conv_id || '_' || turn || '.js' ELSE 'pasted.py' END AS path, "
        "text || chr(10) || 'eval(x); const token = ''abc'';' || chr(10) AS content FROM conversations)"
        + hits_cte("src", "conv_id, turn") + " SELECT conv_id, turn, path, rule_id FROM hits",
    "scan_pages": "WITH src AS (SELECT url AS path, html || '<script>eval(x); document.write(y);</script>' AS content FROM pages)"
        + hits_cte("src") + " SELECT path, rule_id FROM hits",
}
