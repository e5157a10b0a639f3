"""Turns with their texts over a stream, against sessions of the whole table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd

from riskloom.session import scratch_dir
from riskloom.streaming import message_stream
from riskloom.streaming.session_stream import drain

START = datetime(2024, 5, 1)
SCHEMA = "key string, ts timestamp, role string, text string"


def expected(rows, ttl):
    out, state = [], {}
    for key, ts, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        started, last, turn = state.get(key, (None, None, 0))
        if turn == 0 or (ts - last).total_seconds() > ttl:
            started, turn = ts, 0
        state[key] = started, ts, turn + 1
        out.append((key, ts, started, turn + 1, role, text))
    return sorted(out, key=str)


def test_stream_equals_the_whole_table(spark, tmp_path):
    """Batches mixed in time, equal times, a key with most turns, a null text, and sessions that expire while others go on."""
    rng, ttl = random.Random(4), 600
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), START + timedelta(seconds=rng.randrange(0, 9000, 5)), rng.choice(["user", "assistant"]), rng.choice([None, "hi", f"t{i}"])) for i in range(300)]
    rows += [("a", START, "user", "same"), ("a", START, "assistant", "same")]
    end = [("end", START + timedelta(hours=5), "user", "last"), ("end", START + timedelta(hours=9), "user", "very last")]
    batches = [[r for n, r in enumerate(rows) if n % 2 == k] for k in (0, 1)] + [[end[0]], [("a", START + timedelta(hours=6), "user", "again")], [end[1]]]
    source, out, state = str(tmp_path / "turns"), scratch_dir(spark, "messages"), scratch_dir(spark, "state")
    with message_stream.keyed_state(spark):
        for batch in batches:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            drain(message_stream.session_messages(spark.readStream.schema(SCHEMA).parquet(source), "3 hours", ttl), out, state).awaitTermination()
    assert spark.conf.get(message_stream.PROVIDER) != message_stream.ROCKSDB
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    passed = START + timedelta(hours=6)
    assert got == [r for r in expected([*rows, *batches[3], *end], ttl) if r[1] <= passed]
    # "hot" and "b" have been silent for longer than their time to live: nothing of them is left.
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "head").load()
    assert {r.key[0] for r in left.select("key").collect()} == {"a", "end"}


class _State:
    """A value or map state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0
        self.clear = self.rows.clear

    def _called(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._called(bool(self.rows))

    def get(self):
        return self._called(self.rows.get(()))

    def update(self, value):
        self.rows[()] = self._called(value)

    def updateValue(self, key, value):
        self.rows[key] = self._called(value)

    def iterator(self):
        return iter(self._called(list(self.rows.items())))

    def removeKey(self, key):
        del self.rows[self._called(key)]


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, _State())

    getMapState = getValueState

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_turn_costs_a_fraction_of_a_state_call():
    """2,000 turns of one key, let out in two halves: the whole of them in order, in a few dozen calls of the state."""
    turns = [(START + timedelta(seconds=i), "user", f"t{i}") for i in range(2000)]
    random.Random(1).shuffle(turns)
    start = int((START - datetime(1970, 1, 1)).total_seconds()) * 1000
    held, handle = message_stream.SessionTurns(1800), _Handle()
    held.init(handle)
    assert not list(held.handleInputRows(("k",), iter([pd.DataFrame(turns, columns=["ts", "role", "text"])]), _Mark(0)))
    out = [row for ms in (999_000, 5_000_000) for frame in held.handleExpiredTimer(("k",), _Mark(start + ms), None) for row in frame.itertuples()]
    assert [(r.ts, r.started, r.turn_no, r.text) for r in out] == [(START + timedelta(seconds=i), START, i + 1, f"t{i}") for i in range(2000)]
    assert sum(state.calls for state in handle.states.values()) < 100 and not handle.states["waiting"].rows
