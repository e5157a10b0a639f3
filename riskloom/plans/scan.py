"""Whole jobs: upload scan (3.1), path scan to summary (3.2, G11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.severity import severity_of
from riskloom.operators import rollup
from riskloom.operators.enrich import ExplainFn, enrich_with_backend
from riskloom.operators.file_rules import issues_of, prepared
from riskloom.operators.findings import placed_issues, to_findings, with_places
from riskloom.operators.line_rules import cpp_line_findings, js_line_findings
from riskloom.operators.match_rules import js_tree_findings, secrets_of
from riskloom.operators.python_rules import analyze_python
from riskloom.sources.documents import findings_from_json
from riskloom.sources.files import scan_files

SECRETS_FROM = 101  # secrets are numbered from here, after the file rules


def of_suffix(files: DataFrame, suffix: str) -> DataFrame:
    return files.where(F.lower("path").endswith(suffix))


def upload(files: DataFrame, explain_fn: ExplainFn | None = None) -> DataFrame:
    """Files through the file rules, located and enriched: one pass, no shuffle without a backend."""
    return enrich_with_backend(to_findings(files), explain_fn)


def scan_all(files: DataFrame) -> DataFrame:
    """File rules and secret search over one reading of the files: (path, seq, rule_id, type), secrets after the rules."""
    issues = F.transform(issues_of(), lambda i: F.struct(i["seq"].cast("bigint").alias("seq"), i["rule_id"].alias("rule_id"), i["issue"].alias("type")))
    secrets = F.transform(secrets_of(), lambda s, i: F.struct((i + SECRETS_FROM).cast("bigint").alias("seq"), s["rule_id"].alias("rule_id"), s["type"].alias("type")))
    return prepared(files).select("path", F.inline(F.concat(issues, secrets)))


def scan_all_located(files: DataFrame) -> DataFrame:
    """The same findings with line, snippet and message."""
    issues = F.transform(placed_issues(), lambda i: F.struct(
        i["seq"].cast("bigint").alias("seq"), *[i[c].alias(c) for c in ("rule_id", "type", "line", "snippet", "message")]))
    secrets = F.transform(secrets_of(), lambda s, i: F.struct(
        (i + SECRETS_FROM).cast("bigint").alias("seq"), *[s[c].alias(c) for c in ("rule_id", "type", "line", "snippet", "message")]))
    return with_places(files).select("path", F.inline(F.concat(issues, secrets)))


def analyze(files: DataFrame, js_tree: bool = True) -> DataFrame:
    """Findings of .py, .js and .cpp files by their own rules, with a per-file order (`detector`, `seq`).

    JavaScript is judged by the tree rules; `js_tree=False` takes the line rules, as for a host without a parser.
    Each branch is narrow and filters by path before it looks at a text; they meet in a union.
    """
    columns = ["path", "detector", "seq", "type", "line", "snippet", "message"]
    js = (js_tree_findings if js_tree else js_line_findings)(of_suffix(files, ".js")).withColumn("detector", F.lit(1))
    cpp = cpp_line_findings(of_suffix(files, ".cpp")).withColumn("detector", F.lit(1))
    python = analyze_python(of_suffix(files, ".py"))
    return python.select(columns).unionByName(js.select(columns)).unionByName(cpp.select(columns))


def enrich_documents(documents: DataFrame, body: str = "body", explain_fn: ExplainFn | None = None) -> DataFrame:
    """Findings documents in either JSON form -> enriched findings, with the documents' other columns."""
    found = findings_from_json(documents, body)
    return enrich_with_backend(found, explain_fn)


def summary_of_findings(enriched: DataFrame) -> DataFrame:
    """The summary of enriched findings as one row: counts, risk, score, rationale and top files."""
    return summed(enriched.select("path", "severity"))


def top_files_text(scores: DataFrame) -> DataFrame:
    """The three top files as `path:score:issues` in one row; at most three short rows are gathered."""
    entry = F.struct((-F.col("score")).alias("rank"), "path", "score", "issues")
    text = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat_ws(":", e["path"], e["score"].cast("string"), e["issues"].cast("string")))
    return rollup.top_files(scores).agg(F.array_join(text, " ").alias("top_files"))


def summary(files: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Analyse source files into one row with counts, risk, score, rationale and top files. Without files, the risk is Unknown.

    Scores per file come first; the counts over all files are sums of those
    rows, so the findings themselves are aggregated once.
    """
    if files is None:
        return spark.createDataFrame([(0, 0, 0, 0, 0.0, "Unknown", "No files were given.", "")], SUMMARY)
    return summed(analyze(files).select("path", severity_of(F.col("type")).alias("severity")))


SUMMARY = "high bigint, medium bigint, low bigint, total_issues bigint, score double, risk string, rationale string, top_files string"


def summed(found: DataFrame) -> DataFrame:
    """One row of SUMMARY over findings (path, severity)."""
    per_file = rollup.severity_counts(found, by=["path"])
    totals = rollup.with_risk(per_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("high", "medium", "low", "total_issues")]))
    w = rollup.weighted(F.col("high"), F.col("medium"), F.col("low"))
    top = top_files_text(per_file.select("path", w.alias("score"), F.col("total_issues").alias("issues")))
    columns = ["high", "medium", "low", "total_issues", "score", "risk", "rationale"]
    # two one-row tables with different columns, folded into one row
    both = totals.select(columns).unionByName(top, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*columns, "top_files"]])


def summary_of_path(spark: SparkSession, path: str | None) -> DataFrame:
    """G11 for a folder: scan, analyse, sum up."""
    return summary(scan_files(spark, path) if path else None, spark)
