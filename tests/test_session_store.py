"""ST4: a stream of turns against the batch eviction, step by step."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from riskloom.operators import sessions
from riskloom.operators.keyed_table import KeyedTable
from riskloom.session import scratch_dir
from riskloom.streaming import message_stream, session_store

START = datetime(2024, 5, 1)
TURNS, COPIES = "session_id string, ts timestamp", "session_id string, last_active timestamp"
TTL, LATE = 600, timedelta(seconds=60)


def run(spark, tmp_path, batches, copies):
    """Feed the batches one after the other; yields the tables' contents after each, and the newest turn so far."""
    source, state = str(tmp_path / "turns"), scratch_dir(spark, "state")
    live = KeyedTable(spark, scratch_dir(spark, "live"), spark.createDataFrame([], session_store.LIVE_SCHEMA).schema, buckets=8)
    kept = KeyedTable(spark, scratch_dir(spark, "copies"), spark.createDataFrame([], COPIES).schema, buckets=8)
    kept.upsert(spark.createDataFrame(copies, COPIES))
    first = kept.rows()
    with message_stream.keyed_state(spark):
        for batch in batches:
            spark.createDataFrame(batch, TURNS).coalesce(1).write.mode("append").parquet(source)
            changes = session_store.session_changes(spark.readStream.schema(TURNS).parquet(source), first, "60 seconds", TTL)
            session_store.keep_tables(changes, live, kept, state).awaitTermination()
            yield live, kept


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_tables_equal_the_batch_eviction(spark, tmp_path):
    rng = random.Random(3)
    # Sessions that fall silent at different times; some have a copy that is older or newer than their last turn, some only a copy.
    ends = {f"s{i}": START + timedelta(seconds=rng.randrange(0, 3000)) for i in range(25)}
    turns = [(k, end - timedelta(seconds=30 * n)) for k, end in ends.items() for n in range(rng.randrange(1, 4))]
    newest = START + timedelta(seconds=3700)
    asof = newest - LATE
    # Exactly the time to live, and a microsecond more.
    turns += [("edge", asof - timedelta(seconds=TTL)), ("over", asof - timedelta(seconds=TTL, microseconds=1)), ("newest", newest)]
    copies = [(k, ends[k] + timedelta(seconds=rng.choice([-500, 0, 900]))) for k in list(ends)[:15]]
    copies += [("only old", START), ("only new", newest), ("no time", None), ("edge", START), ("over", newest)]
    turns.sort(key=lambda r: r[1])
    (live, kept), = run(spark, tmp_path, [turns], copies)

    said = spark.createDataFrame(turns, TURNS).groupBy("session_id").agg(F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("message_count"))
    want_live, want_kept, _ = sessions.evict(said, spark.createDataFrame(copies, COPIES), F.lit(asof), TTL)
    assert as_set(live.rows()) == as_set(want_live) and as_set(kept.rows()) == as_set(want_kept)
    assert "edge" in {r[0] for r in as_set(live.rows())} and "over" not in {r[0] for r in as_set(live.rows())}


def test_a_session_starts_again_and_other_buckets_stay(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    copies = [(f"c{i}", at(5000)) for i in range(40)] + [("a", at(0))]
    batches = [[("a", at(0)), ("a", at(10)), ("b", at(500))], [("b", at(900))], [("a", at(1000)), ("b", at(1000))]]
    steps, stamps = [], []
    for live, kept in run(spark, tmp_path, batches, copies):
        steps.append({r.session_id: r.message_count for r in live.rows().collect()})
        stamps.append({p: os.stat(p).st_mtime_ns for p in Path(kept.path, "data").rglob("*.parquet")})
    # The watermark stands at 840 after the second batch: "a" has been silent since 10.
    assert steps == [{"a": 2, "b": 1}, {"b": 2}, {"a": 1, "b": 3}]
    assert {p: t for p, t in stamps[1].items() if p in stamps[0]} == stamps[0] and len(stamps[1]) == len(stamps[0]) + 1
    assert stamps[2] == stamps[1]
    assert {r.session_id for r in kept.rows().collect()} == {f"c{i}" for i in range(40)}
