"""Reference lists: URL test (F3), normaliser (F4), merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import sanitize_text, strip


def is_valid_url(url: Column, cleaning: bool = False) -> Column:
    """lower-case http(s) with a dot in the host. The clean-up job also rejects a literal backslash-s."""
    u = strip(url)
    ok = F.contains(F.regexp_extract(u, r"(?U)^https?://([^/\s]+)", 1), F.lit("."))
    if cleaning:
        ok = ok & ~F.contains(u, F.lit(r"\s"))
    return F.coalesce(ok, F.lit(False))


def normalise_references(raw_json: Column, cleaning: bool = False) -> Column:
    """a JSON array of strings and objects -> array<struct<url, description>>; invalid ones drop out."""
    def text(item: Column, *names: str) -> Column:
        fields = [F.when(_kind(F.try_variant_get(item, f"$.{n}", "variant")) == "STRING", F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit(""))) for n in names]
        return F.coalesce(*fields)

    def one(item: Column) -> Column:
        plain = F.when(_kind(item) == "STRING", sanitize_text(F.try_variant_get(item, "$", "string")))
        raw = F.coalesce(plain, text(item, "url", "link", "href"))
        description = F.when(plain.isNull(), sanitize_text(text(item, "description", "name")))
        return F.when(is_valid_url(raw, cleaning), F.struct(sanitize_text(raw).alias("url"), description.alias("description")))

    items = F.try_variant_get(F.try_parse_json(raw_json), "$", "array<variant>")
    return F.coalesce(F.array_compact(F.transform(items, one)), F.array().cast("array<struct<url:string,description:string>>"))


def _kind(item: Column) -> Column:
    return F.schema_of_variant(item)


def count_references(raw_json: Column) -> Column:
    return F.coalesce(F.json_array_length(raw_json), F.lit(0))


def merge_references(explained: Column, known: Column) -> Column:
    """J8, U-2: the explanation's list as it is, then what the knowledge base adds."""
    empty = F.array().cast("array<string>")
    first, second = F.coalesce(explained, empty), F.coalesce(known, empty)
    return F.concat(first, F.filter(F.array_distinct(second), lambda r: ~F.array_contains(first, r)))
