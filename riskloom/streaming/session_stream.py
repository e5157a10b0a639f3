"""ST4, ST5: sessions over streams of turns, closed by their time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.sessions import TTL_SECONDS


def closed_sessions(turns: DataFrame, key: str, ts: str, late: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Sessions that no turn within `ttl` has extended: built-in session windows, merged per task before the shuffle.

    `late` is the caller's choice: turns that come later than that behind the newest one are left out by
    Spark, which counts them in the query's progress (`numRowsDroppedByWatermark`).
    A gap of exactly `ttl` keeps a session going, so the window gap is one
    microsecond longer.
    """
    gap = f"{ttl} seconds 1 microsecond"
    return (
        turns.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("turns"), F.min(ts).alias("started"), F.max(ts).alias("last_active"))
        .drop("w"))


NUMBERED = "key string, ts timestamp, started timestamp, turn_no long"


def numbered_turns(turns: DataFrame, late: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """ST5: (key string, ts timestamp) -> each turn with the start of its session and its place in it.

    Turns wait until the watermark (`late` behind the newest turn) has passed them, so they are counted in the order
    of time however they arrive. The state of a key is its session's start, last turn and count, and the waiting times;
    messages belong in the sink. A session is named by its start, so a key that stays silent for `ttl` leaves no state.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, turn, waiting = state.get if state.exists else (0, 0, 0, [])
        waiting = list(waiting)
        for batch in batches:
            waiting += [t.value // 1000 for t in batch["ts"]]
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        rows = []
        for at in (t for t in waiting if t <= mark * 1000):
            if turn == 0 or (ttl > 0 and at - last > ttl * 1_000_000):
                started, turn = at, 0
            turn, last = turn + 1, at
            rows.append((key[0], pd.Timestamp(at, unit="us"), pd.Timestamp(started, unit="us"), turn))
        waiting = [t for t in waiting if t > mark * 1000]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "ts", "started", "turn_no"])
        silent = last // 1000 + ttl * 1000 + 1
        if not waiting and ttl > 0 and mark >= silent:
            state.remove()
            return
        state.update((started, last, turn, waiting))
        if waiting or ttl > 0:
            state.setTimeoutTimestamp(max(mark + 1, waiting[0] // 1000 + 1 if waiting else silent))

    return turns.withWatermark("ts", late).groupBy("key").applyInPandasWithState(
        step, NUMBERED, "started long, last long, turn long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str, sink: str = "parquet") -> StreamingQuery:
    """Write what has arrived to files, then stop."""
    return stream.writeStream.format(sink).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
