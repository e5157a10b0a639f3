"""Registered queries: file, line and token rules over the corpus (2.2, 2.3, 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, of_type, table
from riskloom.operators import file_rules, findings, line_rules, match_rules

E_COLS = ["path", "seq", "rule_id", "issue"]


def lines(spark, sf_dir):
    return line_rules.lines_of(code_corpus(spark, sf_dir))


def route_language(spark, sf_dir):
    return code_corpus(spark, sf_dir).select("path", file_rules.language_of(F.col("path")).alias("lang"))


def engine_findings(spark, sf_dir):
    return file_rules.engine_findings(code_corpus(spark, sf_dir)).select(*E_COLS)


def engine_sql_gate(spark, sf_dir):
    return file_rules.engine_findings(code_corpus(spark, sf_dir), only=["E08", "E09"]).select("path", "rule_id", "issue")


def scan_headline(spark, sf_dir):
    return file_rules.headline(code_corpus(spark, sf_dir)).select("path", "issue", "n_issues")


def engine_to_findings(spark, sf_dir):
    return findings.to_findings(code_corpus(spark, sf_dir)).select("path", "seq", "type", "line", "snippet")


def locate_issue_line(spark, sf_dir):
    return findings.to_findings(code_corpus(spark, sf_dir)).select("path", F.col("type").alias("issue"), "line")


def dedup_issues(spark, sf_dir):
    """Each file's issues twice, as two detectors would report them: the first of each label stays."""
    once = file_rules.engine_findings(code_corpus(spark, sf_dir)).select("path", "seq", "issue")
    again = once.withColumn("seq", F.col("seq") + 100)
    return findings.dedup_issues(once.unionByName(again)).select("path", "issue", "seq")


def js_line_findings(spark, sf_dir):
    return line_rules.js_line_findings(of_type(code_corpus(spark, sf_dir), ".js", ".ts", ".jsx")).drop("message")


def cpp_line_findings(spark, sf_dir):
    return line_rules.cpp_line_findings(of_type(code_corpus(spark, sf_dir), ".cpp", ".c")).drop("message")


def cpp_fallback_extent(spark, sf_dir):
    return line_rules.cpp_fallback_extent(of_type(code_corpus(spark, sf_dir), ".cpp", ".c")).drop("message")


def secret_matches(spark, sf_dir):
    return match_rules.secret_findings(code_corpus(spark, sf_dir)).drop("message")


def js_token_findings(spark, sf_dir):
    return match_rules.js_token_findings(of_type(code_corpus(spark, sf_dir), ".js", ".ts", ".jsx")).drop("message")


def js_bound_calls(spark, sf_dir):
    return match_rules.js_bound_calls(of_type(code_corpus(spark, sf_dir), ".js", ".ts", ".jsx"))


def js_template_sql(spark, sf_dir):
    return match_rules.js_template_sql(of_type(code_corpus(spark, sf_dir), ".js", ".ts", ".jsx"))


def cpp_calls_extent(spark, sf_dir):
    return match_rules.cpp_calls_extent(of_type(code_corpus(spark, sf_dir), ".cpp", ".c"))


def cpp_literal_decls(spark, sf_dir):
    return match_rules.cpp_literal_decls(of_type(code_corpus(spark, sf_dir), ".cpp", ".c"))


def snippet_context(spark, sf_dir):
    """The context comes from the file's own row, so no text is shuffled."""
    found = line_rules.cpp_fallback_extent(of_type(code_corpus(spark, sf_dir), ".cpp", ".c"), around=2)
    return found.select("path", "seq", "line", F.col("snippet").alias("context"))


def normalize_findings(spark, sf_dir):
    """Findings as loose text fields, one per line of each file, with the gaps that the defaults fill."""
    raw = line_rules.lines_of(code_corpus(spark, sf_dir)).select(
        "path", "line",
        F.when(F.col("line") % 3 != 0, F.lit("Line")).alias("type"),
        F.when(F.col("line") % 4 == 0, F.lit("unknown")).otherwise(F.col("line").cast("string")).alias("raw_line"),
        F.when(F.col("line") % 5 != 0, F.concat(F.lit("\t "), "text", F.lit(" "))).alias("snippet"),
        F.lit(None).cast("string").alias("message"),
    )
    out = findings.normalise(raw.withColumnRenamed("line", "pos").withColumnRenamed("raw_line", "line"))
    return out.select("path", "pos", "type", "line", "snippet", "message")


def scan_snippets(spark, sf_dir):
    """Chat turns as pasted code; a user turn has no file name."""
    turns = table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") != "user", F.concat(F.lit("turn_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".js"))).otherwise("")
    code = F.concat("text", F.lit("\neval(x); const token = 'abc';\n"))
    from riskloom.sources.files import snippets
    files = snippets(turns.select("conv_id", "turn", name.alias("filename"), code.alias("code")))
    return file_rules.engine_findings(files).select("conv_id", "turn", "path", "rule_id")


def scan_pages(spark, sf_dir):
    from riskloom.sources.files import pages
    files = pages(table(spark, sf_dir, "pages"))
    with_hit = files.withColumn("content", F.concat("content", F.lit("<script>eval(x); document.write(y);</script>")))
    return file_rules.engine_findings(with_hit).select("path", "rule_id")


QUERIES = {f.__name__: f for f in [
    lines, route_language, engine_findings, engine_sql_gate, scan_headline, engine_to_findings, locate_issue_line,
    dedup_issues, js_line_findings, cpp_line_findings, cpp_fallback_extent, secret_matches, js_token_findings,
    js_bound_calls, js_template_sql, cpp_calls_extent, cpp_literal_decls, snippet_context, normalize_findings,
    scan_snippets, scan_pages,
]}
