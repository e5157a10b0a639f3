"""What the training-data operators share: reading tables, words, row identity, cut lineage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as in `[\x20\x09-\x0D]`, in a Java regex.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, separators: str = SPACE) -> Column:
    """Words between separators; no words for null."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(parts, lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart. Rows equal in id and text have equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` below the shared checkpoint folder and go on from the written rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="riskloom-llm-")


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for its later tasks; the worker needs no copy of this package."""
    held = vars(sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker")))
    if name not in held:
        held[name] = make()
    return held[name]
