"""The inputs that queries share, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.snippets import SNIPPETS
from riskloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, d, e, b) for i, (d, e, b) in enumerate(SNIPPETS)], "sid bigint, folder string, ext string, body string")


def with_code(documents: DataFrame) -> DataFrame:
    """documents -> (doc_id, source, sid, path, content). Python prose becomes comments so that the files parse.

    The snippet side has a fixed, tiny size, so it is broadcast.
    """
    joined = documents.withColumn("sid", F.expr(f"pmod(doc_id, {len(SNIPPETS)})")).join(
        F.broadcast(snippets(documents.sparkSession)), "sid")
    prose = F.when(F.col("ext") == ".py", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
    return joined.select(
        "doc_id", "source", "sid",
        F.concat(F.lit("repo/"), "source", F.lit("/"), "folder", F.lit("f"), F.col("doc_id").cast("string"), "ext").alias("path"),
        F.concat(prose, F.lit("\n"), "body", F.lit("\n")).alias("content"),
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id"))


def of_type(files: DataFrame, *extensions: str) -> DataFrame:
    name = F.lower("path")
    test = name.endswith(extensions[0])
    for e in extensions[1:]:
        test = test | name.endswith(e)
    return files.where(test)


# ---- the same corpus in SQL ----------------------------------------------------------------

def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


CORPUS_SQL = f"""
snippets AS (SELECT * FROM {values([(i, d, e, b) for i, (d, e, b) in enumerate(SNIPPETS)], "sid, folder, ext, body")}),
corpus AS (
  SELECT doc_id, source, sid, ext, text,
         'repo/' || source || '/' || folder || 'f' || CAST(doc_id AS VARCHAR) || ext AS path,
         length(text) - length(replace(text, chr(10), '')) + 1 AS prose_lines,
         CASE WHEN ext = '.py' THEN '# ' || replace(text, chr(10), chr(10) || '# ') ELSE text END
           || chr(10) || body || chr(10) AS content
  FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = sid
)"""


def corpus_sql(query: str) -> str:
    return f"WITH {CORPUS_SQL.strip()}{query}"
