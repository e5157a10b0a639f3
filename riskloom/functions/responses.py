"""Backend responses as columns: completions (R8), explanations (F7), embeddings (R7), stored JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import let, split_lines, strip

EXPLANATION = "struct<explanation:string,fix:string,references:array<string>>"


def completion_text(raw: Column) -> Column:
    """The text of a completion: first choice's message or text, then `text`, `output`, else the raw body."""
    paths = ["$.choices[0].message.content", "$.choices[0].text", "$.text", "$.output"]
    return F.coalesce(*[F.get_json_object(raw, p) for p in paths], raw)


def parse_explanation(text: Column) -> Column:
    """JSON object with alias keys, else marker lines in plain text."""
    value = F.try_parse_json(text)

    def field(v: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])

    def as_object(v: Column) -> Column:
        none = F.array().cast("array<string>")
        lists = [F.try_variant_get(v, f"$.{n}", "array<string>") for n in ("references", "refs")]
        return F.struct(
            F.coalesce(field(v, "explanation", "explain", "description"), F.to_json(v)).alias("explanation"),
            F.coalesce(field(v, "fix", "remediation"), F.lit("")).alias("fix"),
            F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], none).alias("references"))

    def as_text(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda l, i: F.when(F.rlike(l, F.lit(r"(?i)^(?:fix|remediation):")), i + 1)), lambda i: i.isNotNull())
        last = F.array_max(marks)
        return F.struct(
            text.alias("explanation"),
            F.coalesce(F.array_join(F.slice(lines, last, F.lit(3)), " "), F.lit("")).alias("fix"),
            F.transform(F.filter(lines, lambda l: F.rlike(l, F.lit("(?i)^http"))), strip).alias("references"))

    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(is_object, as_object(value)).otherwise(let(split_lines(text), as_text)).cast(EXPLANATION)


def parse_embeddings(raw: Column) -> Column:
    """One response -> array of vectors. JSON shapes first, then numbers separated by blanks or commas."""
    many = "array<array<double>>"
    v = F.try_parse_json(raw)
    data = F.filter(
        F.transform(F.try_variant_get(v, "$.data", "array<variant>"), lambda d: F.try_variant_get(d, "$.embedding", "array<double>")),
        lambda e: e.isNotNull())
    words = F.filter(F.split(F.translate(strip(raw), ",", " "), r"\s+"), lambda w: w != "")
    numbers = F.transform(words, lambda w: w.try_cast("double"))
    plain = F.when(v.isNull() & (F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull()), F.array(numbers))
    shapes = [
        F.try_variant_get(v, "$.embeddings", many),
        data,
        F.try_variant_get(v, "$", many),
        F.array_compact(F.array(F.try_variant_get(v, "$.embedding", "array<double>"))),
        F.array_compact(F.array(F.try_variant_get(v, "$", "array<double>"))),
        plain,
    ]
    full = [F.array_compact(s) for s in shapes]  # a wrong shape reads as an array of nulls
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in full], F.array().cast(many))


def json_or_raw(text: Column) -> Column:
    """stored JSON as a variant; text that is not JSON comes back under the key `raw`."""
    return F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(text.alias("raw"))))
