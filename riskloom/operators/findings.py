"""Findings: normalise (B9), de-duplicate (W1), convert (B12), locate (J5, W3), context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import line_ends, only_newlines, rstrip, split_lines, strip
from riskloom.operators.file_rules import with_issues

# Label words -> words that mark the source line.
LINE_WORDS = [
    (["password"], ["password", "passwd"]),
    (["api key"], ["api_key", "apikey"]),
    (["aws"], ["akia"]),
    (["jwt"], ["eyj"]),
    (["secret"], ["secret"]),
    (["sql"], ["select", "insert"]),
    (["eval"], ["eval"]),
    (["pickle"], ["pickle"]),
    (["shell"], ["shell"]),
    (["md5", "sha1", "sha-1"], ["md5", "sha1"]),
    (["strcpy"], ["strcpy"]),
    (["system"], ["system"]),
    (["regex"], ["re."]),
]


def locate(label: Column, lowered: Column, simple: Column) -> Column:
    """1-based number of the first line that holds a word belonging to `label`, else null.

    The words hold no line end, so the first matching line is the line of the
    earliest word position in the whole lower-cased text. `simple`: see line_ends.
    Positions are bytes before the word, which need no walk over characters.
    """
    it = F.lower(label)
    size = F.octet_length(lowered)

    def earliest(words: list[str]) -> Column:
        found = [F.nullif(F.octet_length(F.substring_index(lowered, w, 1)), size) for w in words]  # the whole text: not there
        return F.least(*found) if len(found) > 1 else found[0]

    positions = []
    for names, words in LINE_WORDS:
        relevant = F.contains(it, F.lit(names[0]))
        for n in names[1:]:
            relevant = relevant | F.contains(it, F.lit(n))
        positions.append(F.when(relevant, earliest(words)))
    at = F.array_min(F.array(*positions))
    ahead = F.substring(lowered.cast("binary"), F.lit(1), at).cast("string")
    return line_ends(ahead, simple) + 1


def with_places(files: DataFrame) -> DataFrame:
    """Add `issues` with their lines as `placed`, and the file's `lines`; still one row per file."""
    found = F.size("issues") > 0  # files without hits are not worth lower-casing or cutting into lines
    scanned = with_issues(files).withColumns({
        "lowered": F.when(found, F.lower("content")), "simple": F.when(found, only_newlines(F.col("content")))})
    scanned = scanned.withColumn("lines", F.when(found, split_lines(F.col("content"), F.col("simple"))))
    return scanned.withColumn("placed", F.transform("issues", lambda i: F.struct(
        i["seq"].alias("seq"), i["rule_id"].alias("rule_id"), i["issue"].alias("type"),
        locate(i["issue"], F.col("lowered"), F.col("simple")).alias("line"), i["suggestion"].alias("message"))))


def placed_issues() -> Column:
    """`placed` of with_places with the stripped source line as snippet."""
    return F.transform("placed", lambda p: F.struct(
        p["seq"].alias("seq"), p["rule_id"].alias("rule_id"), p["type"].alias("type"), p["line"].alias("line"),
        F.coalesce(strip(F.try_element_at(F.col("lines"), p["line"])), F.lit("")).alias("snippet"),
        p["message"].alias("message")))


def to_findings(files: DataFrame) -> DataFrame:
    """Rule hits as findings with their line, without a shuffle."""
    return with_places(files).select("path", F.inline(placed_issues()))


def dedup_issues(issues: DataFrame) -> DataFrame:
    """Keep the first of equal labels per file. A grouped minimum, so it combines before the shuffle."""
    rest = [c for c in issues.columns if c not in ("path", "issue")]
    first = F.min(F.struct(F.col("seq"), *[F.col(c) for c in rest if c != "seq"])).alias("first")
    return issues.groupBy("path", "issue").agg(first).select("path", "issue", "first.*")


def normalise(findings: DataFrame) -> DataFrame:
    """Defaults for missing fields, line as int or null, stripped snippet."""
    return findings.withColumns({
        "type": F.coalesce("type", F.lit("Unknown")),
        "line": F.expr("try_cast(line AS int)"),
        "snippet": strip(F.coalesce("snippet", F.lit(""))),
        "message": F.coalesce("message", F.lit("")),
    })


def context_of(lines: Column, line: Column, around: int = 1) -> Column:
    """The lines `around` a 1-based line, clamped to the file, right-stripped, joined, stripped."""
    first = F.greatest(line - around, F.lit(1))
    last = F.least(line + around, F.size(lines))
    return strip(F.array_join(F.transform(F.slice(lines, first, last - first + 1), rstrip), "\n"))
