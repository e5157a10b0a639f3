"""Sessions and reports against brute force; streams against batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports, sessions
from riskloom.operators.file_rules import engine_findings
from riskloom.session import scratch_dir
from riskloom.sources.files import scan_files
from riskloom.streaming import findings_stream, session_stream

START = dt.datetime(2024, 1, 1)


def make_events(n=400, seed=5):
    """One user owns most events; some gaps are exactly the time to live, some times are equal."""
    rng = random.Random(seed)
    clock, rows = {}, []
    for i in range(n):
        user = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        clock[user] = clock.get(user, START) + dt.timedelta(seconds=rng.choice([0, 1, 600, 3599, 3600, 3601, 9000]))
        rows.append((i, user, clock[user]))
    return rows


def brute_sessions(rows, ttl):
    last, number, out = {}, {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if user not in last or (ttl > 0 and (ts - last[user]).total_seconds() > ttl):
            number[user] = number.get(user, 0) + 1
        last[user] = ts
        out[i] = number[user]
    return out


@pytest.mark.parametrize("ttl", [3600, 1, 0])
@pytest.mark.parametrize("width", ["1 hour", "1 day"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessionize(spark, ttl, width, kind):
    rows = make_events()
    df = spark.createDataFrame(rows, f"event_id int, user_id int, ts {kind}")
    got = sessions.sessionize(df, "user_id", "ts", "event_id", ttl, width)
    assert got.columns[-1] == "session_no"
    assert {r.event_id: r.session_no for r in got.collect()} == brute_sessions(rows, ttl)


def test_expiry_edges(spark):
    rows = [(1, START), (2, START - dt.timedelta(microseconds=1)), (3, None)]
    df = spark.createDataFrame(rows, "id int, last_active timestamp")
    asof = F.lit(START + dt.timedelta(seconds=3600))
    assert [r[0] for r in df.orderBy("id").select(sessions.is_expired(F.col("last_active"), asof)).collect()] == [False, True, True]
    assert not any(r[0] for r in df.select(sessions.is_expired(F.col("last_active"), asof, 0)).collect())


def test_upsert_last_write_wins(spark):
    schema = "session_id string, messages string, last_active int"
    base = spark.createDataFrame([("a", "old", 9), ("b", "keep", 1)], schema)
    updates = spark.createDataFrame([("a", "new", 3), ("a", "newer", 5), ("c", "made", 1)], schema)
    got = {r.session_id: r.messages for r in sessions.upsert(base, updates).collect()}
    assert got == {"a": "newer", "b": "keep", "c": "made"}


def test_context_of_a_hot_session(spark):
    turns = spark.range(3000).select((F.col("id") % 1 + 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    df = sessions.chat_context(turns)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().history == "\n".join(f"user: {i}" for i in range(2980, 3000))


def test_report_store(spark):
    path = scratch_dir(spark, "store")
    assert reports.last_id(spark, path) == 0

    def batch(n):
        return spark.range(n).select(F.lit("pasted.py").alias("filename"), F.col("id").cast("string").alias("summary"), F.lit("{}").alias("payload"))

    reports.append(batch(50), path, F.lit("2024-01-01 00:00:00"))
    reports.append(batch(30), path, F.lit("2024-01-02 00:00:00"))
    table = spark.read.parquet(path)
    assert sorted(r.id for r in table.collect()) == list(range(1, 81))
    assert table.where("id <= 50 and date(timestamp) = '2024-01-01'").count() == 50
    assert [r.id for r in reports.recent(table, 3).collect()] == [80, 79, 78]
    assert reports.by_id(table, 60).count() == 1 and reports.by_id(table, 99).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("eval(x)\npassword = 'abc'\n")
    (root / "b.cpp").write_text("gets(a);\n")
    (root / "node_modules" / "c.js").write_text("eval(x)\n")
    for flatten in (True, False):
        out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
        findings_stream.write_findings(findings_stream.watch_folder(spark, str(root)), out, state, flatten=flatten).awaitTermination()
        got = spark.read.json(out)
        if not flatten:
            got = got.select("path", F.explode("issues").alias("i")).select("path", "i.rule_id")
        want = {(r.path, r.rule_id) for r in engine_findings(scan_files(spark, str(root))).collect()}
        assert {(r.path.rsplit("/", 1)[-1], r.rule_id) for r in got.collect()} == want and want


def test_numbered_turns_stream(spark, tmp_path):
    """Two batches whose turns are mixed in time wait for each other; a much later turn lets them all out."""
    rows = make_events(200, seed=9)
    source, newest = str(tmp_path / "turns"), max(ts for *_, ts in rows)
    span = newest - min(ts for *_, ts in rows)
    batches = [[(str(u), ts) for n, (_, u, ts) in enumerate(rows) if n % 2 == k] for k in (0, 1)] + [[("other", newest + 3 * span)]]
    out, state = scratch_dir(spark, "numbered"), scratch_dir(spark, "state")
    for batch in batches:
        spark.createDataFrame(batch, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, ts timestamp").parquet(source)
        session_stream.drain(session_stream.numbered_turns(stream, f"{int(span.total_seconds()) + 1} seconds"), out, state).awaitTermination()
    got = sorted((r.key, r.ts, r.turn_no, r.started) for r in spark.read.parquet(out).collect())
    by_event = brute_sessions(rows, 3600)
    sessions = {}
    for i, user, ts in sorted(rows, key=lambda r: r[2]):
        sessions.setdefault((str(user), by_event[i]), []).append(ts)
    assert got == sorted((user, ts, n, times[0]) for (user, _), times in sessions.items() for n, ts in enumerate(times, 1))
