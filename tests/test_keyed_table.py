"""The keyed table: partial rewrites, replays, writers at the same time."""

from __future__ import annotations

import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports
from riskloom.operators.keyed_table import KeyedTable
from riskloom.session import scratch_dir
from riskloom.sources.commit_log import CommitLog, Folder

SCHEMA = "session_id string, messages string, last_active long"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def contents(table):
    return {r.session_id: r.messages for r in table.rows().collect()}


def files(table):
    return {p: os.stat(p).st_mtime_ns for p in Path(table.path, "data").rglob("*.parquet")}


@pytest.fixture
def table(spark):
    made = KeyedTable(spark, scratch_dir(spark, "keyed"), spark.createDataFrame([], SCHEMA).schema, buckets=8)
    made.upsert(rows(spark, *[(str(i), f"m{i}", i) for i in range(100)]))
    return made


def test_one_key_rewrites_one_bucket(spark, table):
    before = files(table)
    table.upsert(rows(spark, ("7", "late", 1), ("7", "latest", 3), ("7", "early", 2)))
    after = files(table)
    assert {p: t for p, t in after.items() if p in before} == before and len(after) == len(before) + 1
    assert contents(table) == {str(i): f"m{i}" for i in range(100)} | {"7": "latest"}
    assert table.lookup("7").first().messages == "latest" and table.lookup("x").count() == 0
    assert len(table.lookup("7").inputFiles()) == 1


def test_delete_leaves_other_buckets(spark, table):
    before = files(table)
    number = table.log.latest()[0]
    table.delete(spark.createDataFrame([("no such key",), (None,)], "session_id string"))
    assert table.log.latest()[0] == number and files(table) == before
    table.delete(rows(spark, ("7", "", 0), ("7", "", 0), ("nobody", "", 0)))
    assert len(files(table)) == len(before) + 1 and set(contents(table)) == {str(i) for i in range(100)} - {"7"}


def test_null_key_equal_times_and_empty_changes(spark, table):
    table.upsert(rows(spark, (None, "a", 5), (None, "b", 5), ("7", None, None)))
    assert contents(table)[None] == "b" and contents(table)["7"] is None
    assert table.upsert(rows(spark, (None, "c", 1)).limit(0)) == table.log.latest()[0]
    table.delete(spark.createDataFrame([(None,)], "session_id string"))
    assert None not in contents(table) and len(contents(table)) == 100
    table.delete(table.rows())
    assert contents(table) == {} and table.rows().columns == ["session_id", "messages", "last_active"]


def test_a_replayed_batch_changes_nothing(spark, table):
    first = table.upsert(rows(spark, ("7", "one", 1)), ("stream", 4))
    table.upsert(rows(spark, ("7", "two", 2)))
    assert table.upsert(rows(spark, ("7", "one", 1)), ("stream", 4)) == first + 1
    assert contents(table)["7"] == "two"


def test_writers_at_the_same_time(spark, table):
    """Each of four writers changes its own keys and one key that all of them change."""
    errors = []

    def work(k):
        try:
            KeyedTable(spark, table.path, table.schema).upsert(rows(spark, (f"own{k}", str(k), k), ("shared", str(k), k), (str(k), "changed", k)))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = contents(table)
    assert {got[f"own{k}"] for k in range(4)} == set("0123") and got["shared"] in "0123"
    assert all(got[str(k)] == "changed" for k in range(4)) and len(got) == 105
    assert table.log.numbers() == list(range(6))


def test_readers_keep_their_manifest_and_clean_removes_replaced_folders(spark, table):
    old = table.rows()
    table.upsert(rows(spark, ("7", "new", 1)))
    assert old.where("session_id = '7'").first().messages == "m7"
    n = len(files(table))
    assert table.clean(keep=1) == 1 and len(files(table)) == n - 1 and table.clean(keep=1) == 0
    assert contents(table)["7"] == "new"
    table.upsert(rows(spark, ("8", "newer", 1)))
    assert table.clean(keep=1) == 1 and len(contents(table)) == 100


def test_staged_changes_are_removed(spark, table):
    base = spark.conf.get("spark.checkpoint.dir")
    left = {p for p in os.listdir(base) if p.startswith("changes-")}
    table.upsert(rows(spark, ("7", "new", 1)))
    assert {p for p in os.listdir(base) if p.startswith("changes-")} == left


def test_rename_that_never_replaces(spark):
    folder = Folder(spark, scratch_dir(spark, "log"))
    for name in ("a", "b"):
        out = folder.fs.create(folder.at(name), False)
        out.write(bytearray(name, "utf-8"))
        out.close()
    assert folder.rename_new(folder.at("a"), folder.at("target"))
    assert not folder.rename_new(folder.at("b"), folder.at("target"))
    assert folder.read("target") == "a" and folder.names("*") == ["target"]


def batch(spark, name, n):
    return spark.range(n).select(F.lit(name).alias("filename"), F.col("id").cast("string").alias("summary"), F.lit("{}").alias("payload"))


def test_reports_of_two_writers(spark):
    path = scratch_dir(spark, "reports")
    errors = []

    def work(name, n, ordered):
        try:
            for _ in range(2):
                reports.append(batch(spark, name, n), path, F.lit("2024-01-01 00:00:00"), ordered=ordered)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=args) for args in (("a", 30, True), ("b", 50, False))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = sorted((r.id, r.filename) for r in spark.read.parquet(path).collect())
    assert [i for i, _ in got] == list(range(1, 161))
    runs = [got[0][1]] + [b for (_, a), (_, b) in zip(got, got[1:]) if a != b]
    assert len(runs) <= 4 and reports.finish(spark, path) == 0
    assert os.listdir(path + "/_staged") == []


@pytest.mark.parametrize("died", ["before it numbered", "while it numbered", "while it moved"])
def test_a_writer_that_died_is_finished(spark, died):
    path = scratch_dir(spark, "reports")
    reports.append(batch(spark, "a", 5), path, F.lit("2024-01-01 00:00:00"))
    staged = path + "/_staged/dead"
    batch(spark, "dead", 7).withColumn("timestamp", F.lit("2024-01-02").cast("timestamp")).write.parquet(staged + "/rows")
    reports.reserve(spark, path, staged, 7)
    reports.append(batch(spark, "c", 3), path, F.lit("2024-01-03 00:00:00"))
    if died != "before it numbered":
        rows = reports.numbered(spark, staged + "/rows", 5).select("id", "filename", "timestamp", "summary", "payload")
        rows.repartition(4).write.parquet(staged + "/out")
        if died == "while it numbered":
            os.unlink(staged + "/out/_SUCCESS")
        else:
            folder = Folder(spark, staged)
            folder.move(folder.names("out/part-*")[0], path)
    assert reports.finish(spark, path) == 1 and reports.finish(spark, path) == 0
    got = sorted((r.id, r.filename) for r in spark.read.parquet(path).collect())
    assert got == [(i, "a" if i < 6 else "dead" if i < 13 else "c") for i in range(1, 16)]
    assert CommitLog(spark, path + "/_ids").numbers() == [0, 1, 2]
