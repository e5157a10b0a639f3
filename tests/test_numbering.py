"""Parts of a file's findings when one file has most of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import rollup

ROWS = "doc int, path string, seq long, type string, line int, snippet string"


def table(spark):
    rng = random.Random(2)
    hot = [(1, "<unknown>", i // 2, rng.choice("ab"), i, f"s{i}") for i in range(30_000)]
    rest = [(d, p, rng.choice([None, i, -i]), "t", i, "x") for d in (1, 2, None) for p in ("a.py", None) for i in range(700)]
    return hot + rest, spark.createDataFrame(hot + rest, ROWS).repartition(7)


@pytest.mark.parametrize("width", [rollup.SLICE, 1000, 7])
def test_numbers_are_those_of_one_sort(spark, width):
    rows, df = table(spark)
    got = sorted((tuple(r) for r in rollup.numbered_parts(df, ["doc"], 1000, width).collect()), key=str)
    want, places = [], {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4])):
        places[r[:2]] = places.get(r[:2], -1) + 1
        want.append((*r, places[r[:2]] // 1000))
    assert got == sorted(want, key=str)


def test_a_hot_file_is_spread_over_tasks(spark):
    _, df = table(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rollup.numbered_parts(df, width=1000).where("path = '<unknown>'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) > 1 and max(r["count"] for r in found) < 20_000


def test_no_rows(spark):
    assert rollup.numbered_parts(spark.createDataFrame([], ROWS)).count() == 0
