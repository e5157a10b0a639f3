"""Roll-ups of findings: counts, score, risk, rationale, file ranking.

All are hash aggregations that combine before the shuffle, so one path, source
or type may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.severity import weight_of

LEVELS = ["High", "Medium", "Low"]


def _level(severity: Column) -> Column:
    return F.coalesce(severity, F.lit("Medium"))


def severity_counts(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """One column per level, zero where there is none. Other severities count in the total only."""
    return findings.groupBy(*by).agg(
        *[F.count_if(_level(F.col("severity")) == level).alias(level.lower()) for level in LEVELS],
        F.count(F.lit(1)).alias("total_issues"))


def weighted(counts_high: Column, counts_medium: Column, counts_low: Column) -> Column:
    return 5 * counts_high + 3 * counts_medium + counts_low


def with_risk(counts: DataFrame) -> DataFrame:
    """G3, G4, G5 on top of G2. The buckets compare whole numbers, so no rounding decides a risk."""
    w = weighted(F.col("high"), F.col("medium"), F.col("low"))
    n = F.col("total_issues")
    score = F.when(n > 0, w / (5 * n)).otherwise(F.lit(0.0))
    parts = [
        F.when(F.col(level.lower()) > 0, F.concat(F.col(level.lower()).cast("string"), F.lit(f" {level.lower()}-severity issue(s)")))
        for level in LEVELS
    ]
    rationale = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return counts.withColumns({
        "weighted": w,
        "score": score,
        "score_2dp": F.bround(score, 2),
        "risk": F.when((n > 0) & (10 * w >= 35 * n), "High").when((n > 0) & (10 * w >= 15 * n), "Medium").otherwise("Low"),
        "rationale": F.coalesce(F.concat(rationale, F.lit(".")), F.lit("No issues detected.")),
    })


def risk_summary(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    return with_risk(severity_counts(findings, by))


def file_scores(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Score and issue count per file; files without findings score 0.

    Files and findings meet in one union and one aggregation instead of a join,
    so a file with very many findings is summed up before it moves.
    """
    rows = findings.select("path", weight_of(_level(F.col("severity"))).alias("score"), F.lit(1).cast("bigint").alias("issues"))
    if files is not None:
        rows = rows.unionByName(files.select("path", F.lit(0).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("issues")))
    return rows.groupBy("path").agg(F.sum("score").alias("score"), F.sum("issues").alias("issues"))


def top_files(scores: DataFrame, n: int = 3) -> DataFrame:
    """O1: a heap per task and one merge; ties go to the smaller path."""
    return scores.orderBy(F.desc("score"), "path").limit(n)


def corpus_summary(findings: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Files, issues and severities per `by` value and over all (ROLLUP). Each file is one row of `files`."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    found = findings.select(*by, zero.alias("f"), *[(_level(F.col("severity")) == l).cast("bigint").alias(l.lower()) for l in LEVELS], one.alias("n"))
    base = files.select(*by, one.alias("f"), *[zero.alias(l.lower()) for l in LEVELS], zero.alias("n"))
    return found.unionByName(base).rollup(*by).agg(
        F.sum("f").alias("total_files"), F.sum("n").alias("total_issues"), *[F.sum(l.lower()).alias(l.lower()) for l in LEVELS])


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings per type, most frequent first, ties by first appearance."""
    return (
        findings.groupBy(F.coalesce("type", F.lit("")).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "seq")).alias("first"))
        .orderBy(F.desc("n"), "first")
        .select("type", "n", F.col("first.path").alias("first_path"), F.col("first.seq").alias("first_seq"))
    )


def usage_counts(enriched: DataFrame) -> DataFrame:
    """Explanations by a backend and by the templates."""
    return enriched.agg(
        F.count_if(F.col("llm_used") == "online").alias("online"), F.count_if(F.col("llm_used") == "offline").alias("offline"))


PART = 1000
SLICE = 10_000  # numbers of `seq` that are counted together
LEAST = -(1 << 62)


def numbered_parts(rows: DataFrame, within: list[str] = (), size: int = PART, width: int = SLICE) -> DataFrame:
    """Add `part`: the rows of a file, counted in the order of `seq`, in parts of `size` rows; ties in `seq` go by type and line.

    One file may have most of the rows, so no window runs over a whole file: rows are counted per slice of `width`
    numbers, the slices' sums give each slice the rows before it, and a row's place is that plus its place in the slice.
    """
    keys = [*within, "path", "slice"]
    sliced = rows.withColumn("slice", F.coalesce(F.floor(F.col("seq") / width), F.lit(LEAST)).cast("long"))  # a null `seq` comes first
    before = F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy("slice")) - F.col("n")
    offsets = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"own_{k}") for k in keys], before.alias("before"))
    order = Window.partitionBy(*keys).orderBy("seq", *[c for c in ("type", "line") if c in rows.columns])
    placed = sliced.withColumn("place", F.row_number().over(order))
    same = reduce(and_, [placed[k].eqNullSafe(offsets[f"own_{k}"]) for k in keys])
    return placed.join(offsets, same).select(*rows.columns, F.floor((F.col("before") + F.col("place") - 1) / size).alias("part"))


def findings_by_file(findings: DataFrame, within: list[str] = (), size: int = PART) -> DataFrame:
    """G1, A10: findings of a file as ordered arrays of at most `size`; the parts in order are the whole list.

    A file, inside its document if `within` names one, may have any number of findings.
    """
    issue = F.struct("seq", "type", "line", "snippet")
    return (
        numbered_parts(findings, within, size).groupBy(*within, "path", "part")
        .agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    )
