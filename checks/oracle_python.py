"""SQL for the Python queries: the expected rows of each snippet, joined to the corpus."""

from __future__ import annotations

from checks import expected
from checks.corpus import corpus_sql, values
from checks.oracle_scan import SECRET_SQL

FACTS = (", py AS (SELECT * FROM corpus WHERE ext = '.py'), expected_facts AS (SELECT * FROM "
         + values(expected.FACTS, "sid, kind, name, parent, args, val, off") + "), expected_rules AS (SELECT * FROM "
         + values(expected.RULES, "sid, rule_id, detector, type, off, snippet")
         + "), facts AS (SELECT path, text, kind, name, parent, args, val, CAST(prose_lines + off AS INTEGER) AS line FROM py JOIN expected_facts e ON py.sid = e.sid)"
         + ", rules AS (SELECT path, rule_id, detector, type, CAST(prose_lines + off AS INTEGER) AS line, snippet FROM py JOIN expected_rules e ON py.sid = e.sid)")


def facts(select: str) -> str:
    return corpus_sql(FACTS + " " + select)


ORACLE = {
    "analyze_python": corpus_sql(FACTS + SECRET_SQL + """ SELECT path, CAST(detector AS INTEGER) AS detector, rule_id, type, line, snippet FROM rules
        UNION ALL SELECT s.path, 1, rule_id, type, line, snippet FROM secrets s JOIN py ON s.path = py.path"""),
    "facts_imports": facts("""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY name) AS INTEGER) AS pos, name
        FROM (SELECT DISTINCT path, name FROM facts WHERE kind = 'imported')"""),
    "facts_functions": facts("""SELECT f.path, f.name, f.args, coalesce(c.calls, '') AS calls, f.val AS docstring, f.line FROM facts f
        LEFT JOIN (SELECT path, parent, string_agg(name, ' ' ORDER BY name) AS calls FROM facts WHERE kind = 'function_call' GROUP BY ALL) c ON c.path = f.path AND c.parent = f.name
        WHERE f.kind = 'function'"""),
    "facts_calls": facts("SELECT path, parent, name, args, line FROM facts WHERE kind = 'function_call'"),
    "external_calls": facts("SELECT path, name, args, line FROM facts WHERE kind = 'function_call' AND regexp_matches(name, '^(requests|socket|urllib|http|ftplib)\\.')"),
    "facts_classes": facts("""SELECT c.path, c.name, c.val AS docstring, c.line, coalesce(string_agg(m.name, ', ' ORDER BY m.line), '') AS methods
        FROM facts c LEFT JOIN facts m ON m.path = c.path AND m.kind = 'method' AND m.parent = c.name WHERE c.kind = 'class' GROUP BY ALL"""),
    "facts_assignments": facts("SELECT path, name AS variable, val AS value, line FROM facts WHERE kind = 'assignment'"),
    "facts_strings": facts("SELECT path, val AS value, line FROM facts WHERE kind = 'string'"),
    "facts_comments": facts("""SELECT path, val AS text, line FROM facts WHERE kind = 'comment'
        UNION ALL SELECT path, CASE WHEN u = '' THEN '# ' ELSE '# ' || u END, CAST(k AS INTEGER) FROM (
          SELECT path, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM py WHERE sid <> 9)"""),
    "facts_control_flow": facts("SELECT path, name AS type, val AS value, line FROM facts WHERE kind = 'control'"),
    "code_facts": facts("SELECT path, kind, count(*) AS n FROM facts WHERE kind <> 'comment' GROUP BY path, kind"),
    "import_popularity": facts("SELECT name, count(DISTINCT path) AS files, count(*) AS times FROM facts WHERE kind = 'imported' GROUP BY name"),
    "call_edges": facts("SELECT parent AS caller, name AS callee, count(*) AS n FROM facts WHERE kind = 'function_call' GROUP BY ALL"),
} | {f"py_P{i}": facts(f"SELECT path, rule_id, type, line, snippet FROM rules WHERE rule_id = 'P{i}'") for i in range(1, 11)}
