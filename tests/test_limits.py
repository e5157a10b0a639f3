"""Long lines, deep nesting and big files must neither hang nor fail."""

from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest

from riskloom.functions.text import on_line
from riskloom.operators import file_rules, line_rules, match_rules, python_rules
from riskloom.operators.code_facts import RULE_KINDS, STRUCTURE_KINDS, code_facts, facts_of

N = 50_000
LONG = {
    "quotes": "f'x " * N + " SELECT", "verbs": "'SELECT x " * N, "assignments": "password " + "a=b " * N, "passwords": "password " * N,
    "calls": "system exec " * N, "blob": 'char x[] = "' + "A" * N * 8 + '"; system', "word": "b" * N * 8 + ' "eval system',
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_lines(files, name):
    source = files((f"{name}.txt", LONG[name]))
    start = time.time()
    for op in (file_rules.engine_findings, line_rules.js_line_findings, line_rules.cpp_line_findings, match_rules.secret_findings,
               match_rules.js_token_findings, match_rules.js_bound_calls, match_rules.cpp_calls_extent, match_rules.cpp_literal_decls):
        op(source).count()
    assert time.time() - start < 60


def test_many_findings_on_one_line(files):
    line = "".join(f'strcpy(a,b);char *n{i} = "a longer literal";' for i in range(1500))
    rows = match_rules.cpp_calls_extent(files(("a.c", line))).orderBy("startColumn").collect()
    assert [r.startColumn for r in rows] == [m.start() + 1 for m in re.finditer(r"strcpy\(", line)]
    assert all(line[r.startColumn - 1:r.endColumn - 1] == "strcpy(a,b)" for r in rows)
    decls = match_rules.cpp_literal_decls(files(("a.c", line))).collect()
    assert len(decls) == 1500 and all(line[r.startColumn - 1:r.endColumn - 1] == r.literal for r in decls)


def test_on_line_is_a_dot_star_chain(spark):
    texts = ["a b c", "b a c", "a\nb c", "a x b\na b x c", "c a a b b c c", "abc", "a b\nc", "", "\na b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", df.t.rlike("(?dU)" + on_line("a", "b", "c")).alias("m")).collect():
        assert r.m == bool(re.search("a.*b.*c", r.t)), r.t


def test_odd_python():
    kinds = frozenset(RULE_KINDS + STRUCTURE_KINDS)
    assert list(facts_of("x = " + "(" * 500 + ")" * 500, kinds)) == []
    assert list(facts_of("x = 1\0", kinds)) == [] and list(facts_of(None, kinds)) == []
    deep = "def f():\n    return g(" + "-" * 3000 + "1)\n"
    list(facts_of(deep, kinds))
    assert [f["value"] for f in facts_of("x = '\\d'\n", frozenset(["string"]))] == ["\\d"]


def test_python_line_ends(files):
    """Form feeds end a line for splitlines only, as for the snippet, not for the parser."""
    rows = python_rules.syntax_findings(files(("a.py", "x = 1\x0c\neval(x)\r\nexec(x)\rinput()\n"))).orderBy("line").collect()
    assert [(r.line, r.snippet) for r in rows] == [(2, ""), (3, "eval(x)"), (4, "exec(x)")]


def test_facts_are_handed_on_in_bounded_batches(files):
    """Texts stay in Arrow's buffer until their turn, and facts leave in batches of bounded rows and characters."""
    made = files(*((f"f{i}.py", "x = 'a'\n" * 1500) for i in range(4)))
    facts = code_facts(made.coalesce(1), ("string",))
    sizes = facts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert facts.groupBy("path").count().collect() and sum(r.n for r in sizes.collect()) == 6000
