"""Findings documents in both JSON forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUE = "type:string,line:string,snippet:string,message:string"
UNKNOWN = "<unknown>"


def findings_from_json(documents: DataFrame, body: str = "body") -> DataFrame:
    """Map form {file: [finding]} and flat form [finding with `file`], told apart by the parsed JSON type.

    Keeps the other columns; adds path, file_ord, seq and the finding's fields.
    A body that is not JSON, or neither form, gives no rows here: see `rejected`.
    """
    rest = [c for c in documents.columns if c != body]
    kind = F.schema_of_variant(F.try_parse_json(F.col(body)))
    fields = ["type", F.expr("try_cast(line AS int)").alias("line"), "snippet", "message"]

    flat = F.from_json(body, f"array<struct<file:string,{ISSUE}>>")
    flat_rows = (
        documents.where(kind.startswith("ARRAY"))
        .select(*rest, F.posexplode(flat).alias("pos", "f")).select(*rest, "pos", "f.*")
        .select(*rest, F.coalesce(F.nullif("file", F.lit("")), F.lit(UNKNOWN)).alias("path"), F.lit(0).alias("file_ord"), F.col("pos").cast("bigint").alias("seq"), *fields)
    )
    grouped = F.from_json(body, f"map<string,array<struct<{ISSUE}>>>")
    map_rows = (
        documents.where(kind.startswith("OBJECT"))
        .select(*rest, F.posexplode(grouped).alias("file_ord", "path", "issues"))
        .select(*rest, "path", "file_ord", F.posexplode("issues").alias("pos", "f"))
        .select(*rest, "path", "file_ord", F.col("pos").cast("bigint").alias("seq"), "f.*")
        .select(*rest, "path", "file_ord", "seq", *fields)
    )
    return flat_rows.unionByName(map_rows)


def rejected(documents: DataFrame, body: str = "body") -> DataFrame:
    """The documents that `findings_from_json` cannot read, with all their columns and the `reason`."""
    parsed = F.try_parse_json(F.col(body))
    kind = F.schema_of_variant(parsed)
    reason = (
        F.when(F.col(body).isNull(), "no document").when(parsed.isNull(), "not JSON")
        .when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), "neither an object nor a list"))
    return documents.withColumn("reason", reason).where(F.col("reason").isNotNull())
