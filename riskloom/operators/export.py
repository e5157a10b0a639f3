"""Exports: nested and flat JSON, SARIF, Markdown digest, dated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions.references import normalise_references
from riskloom.functions.text import sanitize_text
from riskloom.operators.rollup import PART, findings_by_file, numbered_parts, type_counts
from riskloom.session import stored

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0.json"
TOOL = "riskloom"


def nested_json(findings: DataFrame, within: list[str] = (), size: int = PART) -> DataFrame:
    """A10: one JSON object {file: [findings]} per file and part; parts keep a huge file from being one row."""
    parts = findings_by_file(findings, within, size)
    issues = F.transform("issues", lambda i: i.dropFields("seq"))
    return parts.select(*within, "path", "part", F.to_json(F.create_map(F.col("path"), issues)).alias("document"))


def flat_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, the file under `file`."""
    fields = [F.col("path").alias("file"), *[F.col(c) for c in findings.columns if c not in ("path", "seq")]]
    return findings.select("path", F.to_json(F.struct(*fields)).alias("document"))


def _or(*columns: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns])


def sarif_results(findings: DataFrame) -> DataFrame:
    """The flat result rows. Seven fixed rules are broadcast; other types get the default rule."""
    rules = dims.export_rules(findings.sparkSession).select(F.col("type").alias("rule_type"), "rule_id", "level")
    have = set(findings.columns)

    def optional(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("int")

    joined = findings.drop("rule_id").join(F.broadcast(rules), F.col("type") == F.col("rule_type"), "left")
    return joined.select(
        "path", "seq",
        F.coalesce("rule_id", F.lit(dims.EXPORT_DEFAULT[0])).alias("ruleId"),
        F.coalesce("level", F.lit(dims.EXPORT_DEFAULT[1])).alias("level"),
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("type")).alias("message"),
        F.coalesce(_or(optional("startLine"), F.col("line")), F.lit(0)).alias("startLine"),
        _or(optional("startColumn")).alias("startColumn"),
        F.coalesce(_or(optional("endLine"), F.col("line")), F.lit(0)).alias("endLine"),
        _or(optional("endColumn")).alias("endColumn"))


def rule_descriptors() -> Column:
    return F.array(*[
        F.struct(
            F.lit(rule_id).alias("id"), F.struct(F.lit(short).alias("text")).alias("shortDescription"),
            F.struct(F.lit(text).alias("text")).alias("fullDescription"), F.struct(F.lit(level).alias("severity")).alias("properties"))
        for _, rule_id, short, text, level in dims.EXPORT_RULES
    ])


def sarif_documents(findings: DataFrame, size: int = PART) -> DataFrame:
    """Complete SARIF documents, each with the rules and a bounded part of one file's results."""
    result = F.struct(
        "seq", "ruleId", "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
            F.struct("startLine", "startColumn", "endLine", "endColumn").alias("region")).alias("physicalLocation"))).alias("locations"))
    parts = numbered_parts(sarif_results(findings), size=size).groupBy("path", "part").agg(F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.lit(TOOL).alias("name"), rule_descriptors().alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("results", lambda r: r.dropFields("seq")).alias("results"))
    document = F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))
    return parts.select("path", "part", F.to_json(document).alias("document"))


def digest(findings: DataFrame, top: int = 10) -> DataFrame:
    """The Markdown report as ordered lines (section, text): counts per type, then the first findings.

    Written once: the counts and the first findings read what the rules found, and the rules run once.
    """
    spark, findings = findings.sparkSession, stored(findings, "digest")
    nothing = [F.lit("").alias("path"), F.lit(0).cast("bigint").alias("seq")]

    def title(section: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("rank"), *nothing, F.lit(text).alias("text"))

    counted = type_counts(findings).select(
        F.lit(1).alias("section"), (-F.col("n")).alias("rank"), F.col("first_path").alias("path"), F.col("first_seq").cast("bigint").alias("seq"),
        F.concat(F.lit("- **"), "type", F.lit("**: "), F.col("n").cast("string")).alias("text"))
    first = findings.orderBy("path", "seq").limit(top).select(
        F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("rank"), "path", F.col("seq").cast("bigint").alias("seq"),
        F.concat(F.lit("- "), F.coalesce("type", F.lit("")), F.lit(" in `"), "path", F.lit("`:"), F.coalesce(_or(F.col("line"), *[F.col("startLine")] * ("startLine" in findings.columns)).cast("string"), F.lit("None")),
                 F.lit(" - "), F.coalesce("message", F.lit("")), F.lit("  \n  ```\n  "), F.coalesce("snippet", F.lit("")), F.lit("\n  ```")).alias("text"))
    # The same aggregation as for the counts, so Spark runs its shuffle once.
    none = counted.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("rank"), *nothing, F.lit("No issues found.").alias("text"))
    head = counted.agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("rank"), *nothing, F.lit("### First findings").alias("text"))
    lines = title(0, "# Scan summary").unionByName(counted).unionByName(none).unionByName(head).unionByName(first)
    return lines.orderBy("section", "rank", "path", "seq").select("section", "text")


def cleaned(enriched: DataFrame) -> DataFrame:
    """Enriched findings with cleaned texts and only valid references, as objects of URL and description."""
    texts = {c: sanitize_text(F.col(c)) for c in ("explanation", "fix", "message", "snippet") if c in enriched.columns}
    if "references" in enriched.columns:
        texts["references"] = normalise_references(F.to_json("references"), cleaning=True)
    return enriched.withColumns(texts)


def write_run(enriched: DataFrame, root: str, run_ts: str) -> None:
    """An enriched run as JSON lines under its time stamp, and its cleaned twin, made of the written lines.

    The job runs once, so a backend is asked once and both hold its same answers.
    """
    first = f"{root}/stage=enriched/run_ts={run_ts}"
    enriched.write.mode("errorifexists").json(first)
    back = enriched.sparkSession.read.schema(enriched.schema).json(first)
    cleaned(back).write.mode("errorifexists").json(f"{root}/stage=cleaned/run_ts={run_ts}")
