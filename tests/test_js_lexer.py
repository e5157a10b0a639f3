"""JavaScript rules on texts whose findings a parser would give; expectations are written by hand."""

from __future__ import annotations

import pytest

from riskloom.operators import match_rules
from riskloom.operators.js_lexer import lex

CASES = {
    "pattern_with_backtick": ("const r = /`/;\neval(x);", [("JX1", 2)]),
    "pattern_with_quote": ("s.replace(/\"/g, ''); eval(y);", [("JX1", 1)]),
    "pattern_with_class": ("a = /[/\"]/; eval(y); b = '/'", [("JX1", 1)]),
    "text_in_nested_template": ("const t = `a ${ `eval(x)` } b`;", []),
    "code_in_template": ("const t = `a ${ eval(x) } b`;", [("JX1", 1)]),
    "code_in_nested_template": ("t = `a ${ `b ${ eval(\n x) } c` } d`; eval(z)", [("JX1", 1), ("JX1", 2)]),
    "object_in_template": ("t = `${ {a: 1, b: {c: 2}}.a } eval(x)`;\neval(y)", [("JX1", 2)]),
    "division": ("a = b / c; d = e / eval(f);", [("JX1", 1)]),
    "division_behind_bracket": ("a = (b) / eval(c) / d; x[1] / eval(y)", [("JX1", 1), ("JX1", 1)]),
    "division_behind_object": ("a = {b: 1} / eval(c) / 2", [("JX1", 1)]),
    "division_behind_step": ("i++ / eval(c) / 2", [("JX1", 1)]),
    "pattern_behind_head": ("if (a) /eval(b)/.test(c);\nwhile (x) /'/.test(y), eval(z)", [("JX1", 2)]),
    "pattern_behind_block": ("if (a) { b() }\n/eval('x')/.test(c); eval(d)", [("JX1", 2)]),
    "pattern_behind_keyword": ("function f() { return /eval('/.test(x) }\neval(1)", [("JX1", 2)]),
    "member_named_as_keyword": ("a.return / eval(b) / c", [("JX1", 1)]),
    "comment_marks_in_strings": ("a = '//'; eval(b); c = \"/*\"; eval(d)", [("JX1", 1), ("JX1", 1)]),
    "strings_in_comments": ("// it's\neval(a) /* ` */ ; eval(b)", [("JX1", 2), ("JX1", 2)]),
    "open_ends": ("eval(a); b = `never closed ${ c", [("JX1", 1)]),
    "regexp": ("new RegExp('a.*'); s = \"new RegExp('.*')\"; new RegExp(x, '.*')", [("JX4", 1)]),
    "bound": ("const { exec: run, spawn } = require('child_process');\nspawn(x); s = 'spawn(y)'; /spawn(z)/", [("JX3", 2)]),
    "direct": ("require('child_process').exec(a); child_process.exec(b); x.exec(c)", [("JX2", 1), ("JX2", 1)]),
    "sql": ("a = `plain`;\nb = `SELECT ${x} FROM ${`t where ${y}`} z`", [("JX5", 2), ("JX5", 2), ("JX5", 2)]),
    "sql_in_string_only": ("a = 'select `'; b = `ok`", []),
    "dollar": ("a = `$ $x \\` \\${ eval(x) select`", [("JX5", 1)]),
    "empty": ("", []),
}


def test_findings(spark, files):
    made = files(*[(f"{name}.js", text) for name, (text, _) in CASES.items()])
    found = sorted((r.path, r.rule_id, r.line) for r in match_rules.js_tree_findings(made).collect())
    assert found == sorted((f"{name}.js", rule, line) for name, (_, want) in CASES.items() for rule, line in want)


@pytest.mark.parametrize("name", CASES)
def test_length_and_lines_stay(name):
    text = CASES[name][0]
    for out in lex(text)[:2]:
        assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_files_are_read_and_cut_once(spark, files):
    plan = match_rules.js_tree_findings(files(("a.js", "eval(x)")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Exchange" not in plan


def test_long_minified_line():
    text = "var a=/x'/.test(b)?`${c}`:d/e;" * 20_000
    called, bare, templates = lex(text)
    assert len(bare) == len(called) == len(text) and len(templates) == 20_000 and "'" not in bare
