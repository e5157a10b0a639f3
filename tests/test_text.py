"""Text expressions against Python's own str and re."""

from __future__ import annotations

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import file_rules
from riskloom.operators.findings import locate, to_findings
from riskloom.operators.match_rules import SECRETS, TOKEN, blanked

TEXTS = [
    "", "\n", "a", "a\n", "a\r\nb\rc", "x\x0by\x0cz\x1c\x1d\x1e!", "p\x85q r s\n\n", "  　\xa0pad\x1f\t ", "é́ ſ K ß İ",
    "paſſword = 'abcd'", "toKen = \"x\"", "a.b\rc", "​ zero​width ﻿", "tabs\t\tand  blanks",
]


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "c string")


def test_lines_and_strip(spark):
    for r in column(spark, TEXTS).select("c", T.split_lines(F.col("c")).alias("l"), T.strip(F.col("c")).alias("s")).collect():
        assert r.l == r.c.splitlines()
        assert r.s == r.c.strip()


def test_whitespace_is_pythons():
    assert set(T.WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_sanitize(spark):
    for r in column(spark, TEXTS).select("c", T.sanitize_text(F.col("c")).alias("s")).collect():
        kept = "".join(ch for ch in r.c if ch.isprintable())
        assert r.s == re.sub(r"[ \t]+", " ", kept).strip()


@pytest.mark.parametrize("pattern", [".", r"a.b", r"\bword", r"\s+", r"\w+", r"x.*y"])
def test_dialect(spark, pattern):
    for r in column(spark, TEXTS).select("c", T.matches(F.col("c"), pattern).alias("m")).collect():
        assert r.m == bool(re.search(pattern, r.c)), (pattern, r.c)


@pytest.mark.parametrize("secret", SECRETS, ids=[s[0] for s in SECRETS])
def test_located_matches(spark, secret):
    _, pattern, ci, *_ = secret
    texts = TEXTS + [
        "password = 'abcd\nefgh'\nx\npwd='qqqqq' passwd=\"12345\"", "API_KEY='aaaa'\n\nApiKey = \"bbbb\"\x01 apikey='c\x01ccc'",
        "'" + "k" * 25 + "'\n" * 3 + '"' + "Z_-" * 9 + '"', "password='abc'", "\r\npwd = 'wxyz'", "password = 'ab\x01c'\npwd\x1c=\x1f'wxyz'", "pwd='aaaa'pwd='bbbb'",
    ]
    for r in column(spark, texts).select("c", T.located_matches(F.col("c"), pattern, ci).alias("m")).collect():
        want = [(r.c.count("\n", 0, m.start()) + 1, m.group(0)) for m in re.finditer(pattern, r.c, re.IGNORECASE if ci else 0)]
        assert [(m.line, m.text) for m in r.m] == want


def test_python_white_space(spark):
    """U+001C to U+001F are white space for Python only; inside and outside of character classes."""
    texts = [f"eval{c}(x[{c}a" for c in "\x1b\x1c\x1d\x1e\x1f \x85\xa0\u2003"]
    for pattern in (r"eval\s*\(", r"\[[\sb]a", r"\[[^\s]a"):
        for r in column(spark, texts).select("c", T.matches(F.col("c"), pattern).alias("m")).collect():
            assert r.m == bool(re.search(pattern, r.c)), (pattern, r.c)


def test_placed_matches(spark):
    texts = ["a(b(\n\n cc(\x01a(", "", "x", "a(", "\na(\na(", "é東( a(\r\nb("]
    for r in column(spark, texts).select("c", T.placed_matches(F.col("c"), r"\w+\(").alias("m")).collect():
        want = [(r.c.count("\n", 0, m.start()) + 1, m.start() - (r.c.rfind("\n", 0, m.start()) + 1) + 1, m.group(0)) for m in re.finditer(r"\w+\(", r.c)]
        assert [(m.line, m.column, m.text) for m in r.m] == want


def test_gates_never_hide_a_match(spark):
    """Letters that (?i) takes for ASCII ones still pass the `contains` tests in front of the patterns."""
    texts = ["toKen = 'x'", "ſecret = 'x'", "paſſword = \"x\"", "aſſert role", "enćeval(", "éeval(x)"]
    got = file_rules.engine_findings(spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(texts)], "path string, content string"))
    ids = {(r.path, r.rule_id) for r in got.collect()}
    assert {("f0.txt", "E03"), ("f1.txt", "E03"), ("f2.txt", "E05"), ("f3.txt", "E19")} <= ids
    assert not {("f4.txt", "E10"), ("f5.txt", "E10")} & ids  # \b is Unicode: an accented letter is part of the word


@pytest.mark.parametrize("pattern", ["*.py", "te?t", "[abc]*", "[!abc]*", "a[0-9]b", "plain.name", "x[", "*[]]*", "a*b*c", "(x)+"])
def test_globs(spark, pattern):
    names = ["a.py", "test", "tet", "b1", "zz", "a5b", "plain.name", "plainxname", "x[", "q]q", "axxbyyc", "(x)+", "", "a\nb.py"]
    regex = T.glob_regex(pattern)
    for r in column(spark, names).select("c", F.rlike("c", F.lit(regex)).alias("m")).collect():
        assert r.m == fnmatch.fnmatchcase(r.c, pattern), (pattern, r.c)


def test_tokens_cover_the_text(spark):
    texts = ["a // b\n\"c // d\" /* e\n f */ 'g\\'h' `i ${j} \\` k` l / m", "\"open\n'more", "/* never closed", "x = \"" + "\\n" * 20000 + "\";"]
    tokens = F.regexp_extract_all("c", F.lit(TOKEN), F.lit(0))
    for r in column(spark, texts).select("c", F.array_join(tokens, "").alias("all"), blanked(tokens, True).alias("bare")).collect():
        assert r["all"] == r.c
        assert len(r.bare) == len(r.c) and r.bare.count("\n") == r.c.count("\n")
    assert column(spark, texts[:1]).select(blanked(tokens, True)).first()[0].split() == ["a", '"', '"', "'", "'", "`", "`", "l", "/", "m"]


def test_line_ends_are_sought_once_a_file(spark, files):
    body = "é東 # İ\r\npassword = 'abcd'\n"
    df = files(("a.py", body + "eval (x)"), ("b.py", "eval(x)\nPASSWORD = 'x'"), ("c.py", "plain"), ("d.py", None))
    found = to_findings(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(content#\d+, \[\\r", plan)) == 1
    got = sorted((r.path, r.line, r.snippet) for r in found.collect())
    assert got == [("a.py", 3, "password = 'abcd'"), ("a.py", 4, "eval (x)"), ("b.py", 1, "eval(x)"), ("b.py", 2, "PASSWORD = 'x'")]


def test_locate_counts_bytes_ahead(spark):
    texts = ["x\né\npasswd", "no such word", "", None, "password", "é\r\n passwd\npassword"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    at = locate(F.lit("Hardcoded password detected"), F.col("t"), T.only_newlines(F.col("t")))
    got = {r.i: r.line for r in rows.select("i", at.alias("line")).collect()}
    assert got == {0: 3, 1: None, 2: None, 3: None, 4: 1, 5: 3}
    marks = rows.select("i", T.occurrences(F.col("t"), "\n").alias("n")).collect()
    assert {r.i: r.n for r in marks} == {i: t if t is None else t.count("\n") for i, t in enumerate(texts)}
