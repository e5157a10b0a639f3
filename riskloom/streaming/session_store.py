"""ST4: sessions that a stream keeps live, in a stored table, and evicts there together with their stored copies.

Every session has a timer; when the watermark passes its time to live, the session
leaves the state and `foreachBatch` removes it from the tables.  Only buckets that
hold a changed session are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.keyed_table import KeyedTable
from riskloom.operators.sessions import TTL_SECONDS
from riskloom.session import stored

CHANGES = "session_id string, change string, last_active timestamp, message_count long"
LIVE_SCHEMA = "session_id string, last_active timestamp, message_count long"
NONE = -1  # no time, no timer


class LiveSessions(StatefulProcessor):
    """Times are in microseconds since the epoch, timers in milliseconds.

    `changes` are live (put it into the live table), gone (live session expired: remove it and its stored copy) and
    stale (only the stored copy has expired).
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "live long, messages long, stored long, timer long")

    def _due(self, live: int, copy: int, mark: int) -> int:
        """The first millisecond at which one of the two is older than `ttl`."""
        times = [t // 1000 + self.ttl * 1000 + 1 for t in (live, copy) if t != NONE]
        return max(min(times), mark + 1) if times and self.ttl > 0 else NONE

    def _keep(self, live: int, messages: int, copy: int, old: int, mark: int) -> None:
        due = self._due(live, copy, mark)
        if old not in (NONE, due):
            self.handle.deleteTimer(old)
        if due not in (NONE, old):
            self.handle.registerTimer(due)
        if live == NONE and copy == NONE:
            self.head.clear()
        else:
            self.head.update((live, messages, copy, due))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Stored sessions from before the stream; one without a time counts as expired."""
        times = initialState["at"].dropna()
        self._keep(NONE, 0, int(times.max()) if len(times) else 0, NONE, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        live, messages, copy, timer = self.head.get() if self.head.exists() else (NONE, 0, NONE, NONE)
        for batch in rows:
            live, messages = max(live, int(batch["at"].max())), messages + len(batch)
        self._keep(live, messages, copy, timer, timerValues.getCurrentWatermarkInMs())
        yield self._change(key, "live", live, messages)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        live, messages, copy, _ = self.head.get()
        old = lambda t: t != NONE and mark * 1000 - t > self.ttl * 1_000_000
        if old(live):
            yield self._change(key, "gone", live, messages)
            live, messages, copy = NONE, 0, NONE
        elif old(copy):
            yield self._change(key, "stale", copy, 0)
            copy = NONE
        self._keep(live, messages, copy, NONE, mark)  # the timer that has fired is gone by itself

    @staticmethod
    def _change(key: Any, change: str, at: int, messages: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "change": [change], "last_active": [pd.Timestamp(at, unit="us")], "message_count": [messages]})

    def close(self) -> None:
        pass


def session_changes(turns: DataFrame, copies: DataFrame, late: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """(session_id string, ts timestamp), a stream, and stored (session_id string, last_active timestamp) -> CHANGES.

    Turns later than the watermark (`late` behind the newest) are left out by Spark, which counts them. A `ttl` of 0
    never expires. Start the query inside of `message_stream.keyed_state`.
    """
    at = turns.withWatermark("ts", late).where("session_id IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_micros("ts"))
    known = copies.where("session_id IS NOT NULL").select("session_id", F.unix_micros("last_active").alias("at")).groupBy("session_id")
    return at.groupBy("session_id").transformWithStateInPandas(LiveSessions(ttl), CHANGES, "append", "eventTime", initialState=known)


def keep_tables(changes: DataFrame, live: KeyedTable, copies: KeyedTable, checkpoint: str, name: str = "sessions") -> StreamingQuery:
    """Apply what has arrived to both tables, then stop. `name` tells this stream's batches, so a batch that is replayed changes nothing twice."""
    def apply(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "session-changes")  # one run of the stateful plan
        kinds = {r[0] for r in rows.select("change").distinct().collect()}
        gone = rows.where("change = 'gone'").select("session_id")
        if "live" in kinds:
            live.upsert(rows.where("change = 'live'").drop("change"), (f"{name}/put", number))
        if "gone" in kinds:
            live.delete(gone, (f"{name}/gone", number))
        if kinds & {"gone", "stale"}:
            copies.delete(rows.where("change <> 'live'").select("session_id"), (f"{name}/copies", number))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
