"""Line rules for JavaScript and C/C++ (B1, B6, B7, JS1-JS5, CP1-CP2, CX3).

Lines are exploded without the file text, tested in place, and only hit lines
go on: a narrow map-side job with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import folded, matches, on_line, split_lines, strip
from riskloom.operators.findings import context_of

# C and C++ names that CP1 and CX1 look for.
C_NAMES = ["system", "popen", "exec", "strcpy", "gets", "sprintf"]


def lines_of(files: DataFrame) -> DataFrame:
    """B1: (path, line, text), numbered from 1, cut as str.splitlines does."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text"
    )


def hit(order: int, test: Column, kind: str, message: str) -> Column:
    return F.when(test, F.struct(F.lit(order).alias("rule"), F.lit(kind).alias("type"), F.lit(message).alias("message")))


def word(text: Column, name: str) -> Column:
    return F.contains(text, F.lit(name))


def js_hits(text: Column, upper: Column) -> list[Column]:
    sql = word(upper, "SELECT") | word(upper, "INSERT") | word(upper, "UPDATE") | word(upper, "DELETE")
    secret = word(upper, "PASSWORD") | word(upper, "API_KEY") | word(upper, "SECRET")
    return [
        hit(1, word(text, "eval") & matches(text, r"\beval\s*\("), "Insecure Function Usage", "eval() runs its input as code."),
        hit(2, word(text, "RegExp") & word(text, ".*") & matches(text, r"\bRegExp\b"), "Insecure Regex", "The pattern holds '.*' and may match too much."),
        hit(3, (word(text, "child_process.") | word(text, "exec")) & matches(text, r"\b(child_process\.|\bexec\s*\(|\.exec\()"), "Suspicious Subprocess Call", "A command may be run; check its input."),
        hit(4, (word(text, "+") | word(text, "${")) & sql & matches(text, r"\b(select|insert|update|delete)\b", ci=True), "Possible SQL Injection", "SQL text is joined with other values; bind them instead."),
        hit(5, secret & matches(text, r"""\b(password|api_key|secret)\b\s*[:=]\s*['"]""", ci=True), "Hardcoded Secret", "A secret is written into the source."),
    ]


def c_hits(text: Column, upper: Column) -> list[Column]:
    # A name somewhere before the last "(" on the line; a direct call is a special case of that.
    calls = [
        hit(i, word(text, fn) & matches(text, on_line(fn, r"\(")), "Dangerous Function", f"{fn} is unsafe; choose a bounded or checked function.")
        for i, fn in enumerate(C_NAMES, 1)
    ]
    secret = word(upper, "PASSWORD") | word(upper, "API_KEY") | word(upper, "SECRET")
    return calls + [
        hit(7, secret & matches(text, on_line(r"\b(?:password|api_key|secret)\b", "=", "['\"]"), ci=True), "Hardcoded Secret", "A secret is written into the source.")
    ]


def line_findings(files: DataFrame, hits) -> DataFrame:
    """(path, seq, type, line, snippet, message); seq follows line order, then rule order."""
    lines = lines_of(files).withColumn("folded", folded(F.col("text")))
    found = F.array_compact(F.array(*hits(F.col("text"), F.col("folded"))))
    return (
        lines.select("path", "line", "text", F.inline(found))
        .select("path", (F.col("line").cast("bigint") * 10 + F.col("rule")).alias("seq"), "type", "line", strip(F.col("text")).alias("snippet"), "message")
    )


def js_line_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, js_hits)


def cpp_line_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, c_hits)


def cpp_fallback_extent(files: DataFrame, around: int = 1) -> DataFrame:
    """CX3: the C/C++ line rules with start/end line and a context snippet, all inside the file's row."""
    with_lines = files.select("path", split_lines(F.col("content")).alias("lines"))

    def per_line(text: Column, pos: Column) -> Column:
        found = F.array_compact(F.array(*c_hits(text, folded(text))))
        return F.transform(found, lambda h: F.struct(
            h["rule"].alias("rule"), h["type"].alias("type"), (pos + 1).alias("line"), h["message"].alias("message")))

    hits = F.flatten(F.transform("lines", per_line))
    return (
        with_lines.withColumn("hits", hits)
        .select("path", F.inline(F.transform("hits", lambda h: F.struct(
            (h["line"].cast("bigint") * 10 + h["rule"]).alias("seq"), h["type"].alias("type"), h["line"].alias("line"),
            h["line"].alias("startLine"), F.lit(None).cast("int").alias("startColumn"),
            h["line"].alias("endLine"), F.lit(None).cast("int").alias("endColumn"),
            context_of(F.col("lines"), h["line"], around).alias("snippet"), h["message"].alias("message")))))
    )
