"""Source files as a (path, content) table: folders, archives, pasted code, fetched pages."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.dims import SOURCE_EXTENSIONS, VENDOR_DIRS, strings
from riskloom.functions.text import glob_regex


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def exclude_vendor(files: DataFrame, folders: list[str] = VENDOR_DIRS) -> DataFrame:
    """A3: drop files that have a vendor folder anywhere in their path."""
    return files.where(~F.arrays_overlap(parts_of(F.col("path")), strings(folders)))


def exclude_globs(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop files of which any path part matches a glob."""
    if not patterns:
        return files
    regex = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return files.where(~F.exists(parts_of(F.col("path")), lambda p: p.rlike(regex)))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case-insensitive test of the path's last suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)).isin(extensions)


def read_binary(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path relative to `root`, content bytes). Vendor filters must not see the parents of the root."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace("path", F.lit(r"^(?:[a-z0-9]+:(?://[^/]*)?)?" + _quoted(base) + "/?"), F.lit(""))
    return reader.load(root).select(F.when(relative == "", F.element_at(parts_of(F.col("path")), -1)).otherwise(relative).alias("path"), "content")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def scan_files(spark: SparkSession, root: str, recursive: bool = True, extensions: list[str] = SOURCE_EXTENSIONS,
               ignore_vendor: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The source files of a folder (or one file), strictly decoded; files that are not UTF-8 drop out."""
    files = read_binary(spark, root, recursive).where(has_extension(F.col("path"), extensions))
    if ignore_vendor:
        files = exclude_vendor(files)
    files = exclude_globs(files, list(exclude))
    return decode_strict(files)


def decode_strict(files: DataFrame) -> DataFrame:
    """Keep only valid UTF-8, with universal newlines as a text-mode read gives them."""
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.withColumn("content", F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))


REPLACEMENT = "\ufffd"
REPLACEMENT_BYTES = "\xef\xbf\xbd"  # its UTF-8 bytes, each as a character


def decode_lossy(files: DataFrame) -> DataFrame:
    """Drop undecodable bytes, and only those.

    Valid text is taken as it is.  Other bytes are cut at genuine replacement
    characters, so those that mark a dropped byte can be told from them.
    """
    def cleaned(piece: Column) -> Column:
        return F.replace(F.make_valid_utf8(F.encode(piece, "ISO-8859-1").cast("string")), F.lit(REPLACEMENT), F.lit(""))

    text = F.col("content").cast("string")
    pieces = F.split(F.decode("content", "ISO-8859-1"), REPLACEMENT_BYTES, -1)
    mended = F.array_join(F.transform(pieces, cleaned), REPLACEMENT)
    return files.withColumn("content", F.when(F.is_valid_utf8(text), text).otherwise(mended))


def snippets(pasted: DataFrame, default_name: str = "pasted.py") -> DataFrame:
    """(filename, code, ...) -> (path, content, ...); an empty or missing name gets the default."""
    rest = [c for c in pasted.columns if c not in ("filename", "code")]
    name = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit(default_name))
    return pasted.select(*rest, name.alias("path"), F.col("code").alias("content"))


def pages(fetched: DataFrame) -> DataFrame:
    """Fetched pages as files; the URL is the name, so its tail routes the language."""
    return fetched.select(F.col("url").alias("path"), F.col("html").alias("content"))


FRAME_BYTES, FRAME_ROWS = 16 << 20, 2000  # members go back to the JVM in frames of about this size
MEMBERS = "archive string, member string, data binary, error string"


def _members(name: str, data: bytes) -> Iterator[tuple]:
    lower = name.lower()
    if lower.endswith(".zip"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    try:  # a folder entry counts as an empty file
                        yield name, info.filename, z.read(info), None
                    except Exception:  # an unreadable member is skipped, the others still count
                        continue
        except Exception as e:  # a broken archive gives one error row
            yield name, None, None, str(e)
        return
    if lower.endswith((".tar", ".tgz", ".tar.gz")):
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for member in t:
                    if member.isreg():
                        yield name, member.name, t.extractfile(member).read(), None
            return
        except Exception:  # members before the break count; then the bytes pass as plain text
            pass
    yield name, name, data, None


def expand_archives(files: DataFrame) -> DataFrame:
    """A5, U4: (path, content bytes) -> (archive, path, content, error), lossily decoded.

    Only files whose name says archive go to Python; the rest stays in the JVM.
    """
    archive = F.lower("path").rlike(r"\.(?:zip|tar|tgz|tar\.gz)\z")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                for row in _members(name, data):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                        yield pd.DataFrame(rows, columns=["archive", "member", "data", "error"])
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["archive", "member", "data", "error"])

    unpacked = files.where(archive).select("path", "content").mapInPandas(unpack, MEMBERS)
    plain = files.where(~archive).select(
        F.col("path").alias("archive"), F.col("path").alias("member"), F.col("content").alias("data"), F.lit(None).cast("string").alias("error"))
    both = unpacked.unionByName(plain)
    return decode_lossy(both.withColumnRenamed("data", "content")).select("archive", F.coalesce("member", "archive").alias("path"), "content", "error")
