"""ST1, A12: findings of files as they arrive, by the batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.file_rules import engine_findings
from riskloom.sources.files import decode_strict, exclude_vendor, has_extension
from riskloom.dims import SOURCE_EXTENSIONS

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(spark: SparkSession, root: str, extensions: list[str] = SOURCE_EXTENSIONS, files_per_batch: int = 1000) -> DataFrame:
    """Source files below `root` as a stream."""
    stream = (
        spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).load(root).select("path", "content"))
    return decode_strict(exclude_vendor(stream.where(has_extension(F.col("path"), extensions))))


def write_findings(files: DataFrame, out: str, checkpoint: str, sink: str = "json", flatten: bool = True) -> StreamingQuery:
    """Findings of a stream of (path, content) to JSON lines: one per finding, or one per file. Drains what is there, then stops."""
    found = engine_findings(files.select("path", "content"))
    if not flatten:
        from riskloom.operators.file_rules import with_issues
        found = with_issues(files).select("path", "issues")
    return (
        found.writeStream.format(sink).option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())
