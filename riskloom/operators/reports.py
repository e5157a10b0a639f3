"""The report table: numbered appends, recent reports, lookup."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.sources.commit_log import CommitLog, Folder

SCHEMA = "id bigint, filename string, timestamp timestamp, summary string, payload string"
DEFAULT_LIMIT = 50  # fixed value


def numbered(spark: SparkSession, staged: str, base: int = 0) -> DataFrame:
    """Rows of a stored table with `id`: base + 1, base + 2, ... in the order of the numbers of its part files, without gaps.

    A row's id is its place in its file plus the rows of the files before, so
    no rows are shuffled or ranked; only one count per file is summed up.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(staged).select("*", part.alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("__before"))
    return rows.join(offsets, "__file").withColumn("id", F.lit(base) + F.col("__before") + F.col("__at") + 1).drop("__file", "__at", "__before")


def last_id(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.schema(SCHEMA).parquet(path).agg(F.max("id")).first()[0] or 0
    except AnalysisException:  # no table yet
        return 0


def append(reports: DataFrame, path: str, timestamp: Column, *order: str, ordered: bool = True) -> None:
    """Add a batch of (filename, summary, payload) under ids above all earlier ones. Any number of writers.

    The batch is first written next to the table, in `order` (default: by
    filename) or, without `ordered`, as its tasks deliver it, which needs no
    shuffle; its files then number it. The random last sort key spreads equal
    names, such as the default name of pasted code, over several tasks.
    The batch reserves its range of ids by publishing the next entry of the
    store's log, which one writer only can do; so ranges are disjoint and
    without gaps, whoever writes first. A writer that dies later leaves its
    rows to `finish`.
    """
    spark = reports.sparkSession
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    rows = reports.select("filename", "summary", "payload", timestamp.cast("timestamp").alias("timestamp"))
    (rows.orderBy(*(order or ("filename",)), F.rand(7)) if ordered else rows).write.parquet(staged + "/rows")
    _complete(spark, path, reserve(spark, path, staged, spark.read.parquet(staged + "/rows").count()))


def reserve(spark: SparkSession, path: str, staged: str, n: int) -> int:
    """Take the next `n` ids for the `rows` of a staged folder; returns the number of the reservation."""
    log = CommitLog(spark, path + "/_ids")
    while True:
        number, newest = log.latest()
        last = newest["last"] if newest else last_id(spark, path)  # a table from before there was a log
        if log.publish(number + 1, {"first": last + 1, "last": last + n, "staged": staged}):
            return number + 1


def _complete(spark: SparkSession, path: str, number: int) -> None:
    """Number the rows in a folder of the batch, then move its files into the table: writers share no output folder.

    Every step can be done again: files are moved once the folder is whole, and a file that has been moved is not there any more.
    """
    log = CommitLog(spark, path + "/_ids")
    entry = log.read(number)
    batch = Folder(spark, entry["staged"])
    if not batch.names("out/_SUCCESS"):
        rows = numbered(spark, entry["staged"] + "/rows", entry["first"] - 1).select("id", "filename", "timestamp", "summary", "payload")
        rows.write.mode("overwrite").parquet(entry["staged"] + "/out")
    for name in batch.names("out/part-*"):
        batch.move(name, path)
    log.folder.write_new(f"{number:012d}.done", "")
    batch.remove(".")


def finish(spark: SparkSession, path: str) -> int:
    """Write the rows of reservations whose writers died; returns their number. Call it when no writer is at work."""
    log = CommitLog(spark, path + "/_ids")
    done = {int(name[:-5]) for name in log.folder.names("[0-9]*.done")}
    left = [n for n in log.numbers() if n not in done]
    for n in left:
        _complete(spark, path, n)
    return len(left)


def recent(reports: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """O3: newest first, without the payload."""
    return reports.select("id", "filename", "timestamp", "summary").orderBy(F.desc("id")).limit(limit)


def by_id(reports: DataFrame, report_id: int) -> DataFrame:
    """The filter reaches the Parquet footers."""
    return reports.where(F.col("id") == report_id)
