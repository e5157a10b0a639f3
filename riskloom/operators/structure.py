"""Views of code structure over the facts (S1-S9, B13) and corpus-level counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.code_facts import code_facts

NETWORK = r"^(requests|socket|urllib|http|ftplib)\."  # fixed value


def imports(files: DataFrame) -> DataFrame:
    """Sorted distinct imported names of each file, one row per name (`pos` from 1)."""
    names = code_facts(files, ("imported",)).groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return names.select("path", F.posexplode("names").alias("pos", "name")).select("path", (F.col("pos") + 1).alias("pos"), "name")


def functions(files: DataFrame) -> DataFrame:
    """Functions with their arguments, docstring and the names they call, breadth first, repeats included."""
    calls = F.coalesce("flags", F.array().cast("array<string>"))
    return code_facts(files, ("function",)).select("path", "visit_seq", "name", "args", calls.alias("calls"), F.col("value").alias("docstring"), "line")


def function_calls(files: DataFrame) -> DataFrame:
    """S3: calls inside functions; a call in a nested function shows once per enclosing function."""
    return code_facts(files, ("function_call",)).select("path", "visit_seq", "parent", "name", "args", "line")


def external_calls(files: DataFrame) -> DataFrame:
    """S9, B13."""
    return function_calls(files).where(F.col("name").rlike(NETWORK))


def classes(files: DataFrame) -> DataFrame:
    """Classes with their direct methods. A class is named by its file and line."""
    facts = code_facts(files, ("class",))
    is_class = F.col("kind") == "class"
    method = F.struct("visit_seq", "name", "args", F.col("value").alias("docstring"), "line")
    return (
        facts.groupBy("path", F.when(is_class, F.col("line")).otherwise(F.col("qual").cast("int")).alias("line"))
        .agg(
            F.max(F.when(is_class, F.col("name"))).alias("name"),
            F.max(F.when(is_class, F.col("value"))).alias("docstring"),
            F.array_sort(F.collect_list(F.when(~is_class, method))).alias("methods"))
    )


def assignments(files: DataFrame) -> DataFrame:
    return code_facts(files, ("assignment",)).select("path", "visit_seq", F.col("name").alias("variable"), "value", "line")


def strings(files: DataFrame) -> DataFrame:
    return code_facts(files, ("string",)).select("path", "visit_seq", "value", "line")


def comments(files: DataFrame) -> DataFrame:
    return code_facts(files, ("comment",)).select("path", "visit_seq", F.col("value").alias("text"), "line")


def control_flow(files: DataFrame) -> DataFrame:
    return code_facts(files, ("control",)).select("path", "visit_seq", F.col("name").alias("type"), "value", "line")


def import_popularity(files: DataFrame) -> DataFrame:
    """In how many files each name is imported. Two plain counts, no set of paths is collected."""
    per_file = code_facts(files, ("imported",)).groupBy("name", "path").agg(F.count(F.lit(1)).alias("times"))
    return per_file.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("times").alias("times"))


def call_edges(files: DataFrame) -> DataFrame:
    return function_calls(files).groupBy(F.col("parent").alias("caller"), F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"))
