"""ST5 with messages: the turns of live sessions, kept in keyed state until the watermark has passed them.

Waiting turns lie in a map state in chunks of bounded size, each under its earliest
time: every access to the state is a call from Python to the JVM, so a turn costs a
fraction of one, and a key with most of the turns is many small rows of the state
store and never one growing array.  A timer lets out what the watermark has passed,
in the order of time; a later timer clears the state of a session that nothing has
extended for `ttl`, so the key's next turn starts an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.sessions import TTL_SECONDS

MESSAGES = "key string, ts timestamp, started timestamp, turn_no long, role string, text string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIMER = -1
CHUNK_TURNS, CHUNK_CHARS = 500, 1 << 18  # a chunk is closed when it reaches either


def chunks(turns: list[tuple]) -> Iterator[list[tuple]]:
    """Turns (time, role, text) in the order of time, cut into chunks; equal times keep their order."""
    held, size = [], 0
    for turn in sorted(turns, key=lambda t: t[0]):
        held.append(turn)
        size += len(turn[1] or "") + len(turn[2] or "")
        if len(held) >= CHUNK_TURNS or size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


class SessionTurns(StatefulProcessor):
    """Times are in microseconds since the epoch, timers in milliseconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "started long, last long, turn long, number long, timer long")
        self.waiting = handle.getMapState("waiting", "at long, number long", "at array<long>, role array<string>, text array<string>")

    def _hold(self, chunk: list[tuple], number: int) -> None:
        at, role, text = map(list, zip(*chunk, strict=True))
        self.waiting.updateValue((at[0], number), (at, role, text))

    def _set_timer(self, old: int, new: int) -> int:
        if old != new and old != NO_TIMER:
            self.handle.deleteTimer(old)
        if old != new and new != NO_TIMER:
            self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        started, last, turn, number, timer = self.head.get() or (0, 0, 0, 0, NO_TIMER)
        first = None
        for batch in rows:
            at = (batch["ts"].astype("datetime64[ns]").astype("int64") // 1000).tolist()
            for chunk in chunks(list(zip(at, batch["role"], batch["text"], strict=True))):
                self._hold(chunk, number)
                number, first = number + 1, chunk[0][0] if first is None else min(first, chunk[0][0])
        if first is not None:
            due = max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1)
            timer = self._set_timer(timer, due if timer == NO_TIMER else min(timer, due))
        self.head.update((started, last, turn, number, timer))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        started, last, turn, number, timer = self.head.get()
        reached, later = [], None
        for (at, own), held in self.waiting.iterator():
            if at <= mark * 1000:
                reached.append((own, at, held))
            else:
                later = at if later is None else min(later, at)
        due = []
        for own, first, held in sorted(reached, key=lambda c: c[0]):  # as they came
            passed = sum(at <= mark * 1000 for at in held[0])
            due += list(zip(*held, strict=True))[:passed]
            self.waiting.removeKey((first, own))
            if passed < len(held[0]):
                rest = list(zip(*held, strict=True))[passed:]
                self._hold(rest, own)
                later = rest[0][0] if later is None else min(later, rest[0][0])
        due.sort(key=lambda r: (r[0], r[1] or "", r[2] or ""))
        places = []
        for at, _, _ in due:
            if turn == 0 or (self.ttl > 0 and at - last > self.ttl * 1_000_000):
                started, turn = at, 0
            turn, last = turn + 1, at
            places.append((started, turn))
        silent = last // 1000 + self.ttl * 1000 + 1
        if later is None and self.ttl > 0 and mark >= silent:
            self.head.clear()
        else:
            new = -(-later // 1000) if later is not None else silent if self.ttl > 0 else NO_TIMER
            # The timer that has just fired is gone by itself.
            self.head.update((started, last, turn, number, self._set_timer(NO_TIMER, new)))
        if due:
            (at, role, text), (begun, no) = zip(*due, strict=True), zip(*places, strict=True)
            times = (np.array(t, dtype="int64").astype("datetime64[us]") for t in (at, begun))
            yield pd.DataFrame(dict(zip(["key", "ts", "started", "turn_no", "role", "text"], [[key[0]] * len(due), *times, no, role, text], strict=True)))

    def close(self) -> None:
        pass


def session_messages(turns: DataFrame, late: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key string, ts timestamp, role string, text string) -> MESSAGES, each turn once the watermark (`late` behind the newest) has passed it.

    Turns of equal time go by role, then text. A turn later than the watermark is left out by Spark, which counts it.
    Start the query inside of `keyed_state`.
    """
    return turns.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(SessionTurns(ttl), MESSAGES, "append", "eventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the provider that map states and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
