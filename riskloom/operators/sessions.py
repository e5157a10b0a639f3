"""Conversation sessions: expiry, sessionising, context, merge, upsert (A16-A18, A23, ST2, ST3, ST5, ST6, W6, J9, J12, G12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600  # fixed values: default time to live and context length
CONTEXT_TURNS = 10


def seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def is_expired(last_active: Column, asof: Column, ttl: int = TTL_SECONDS) -> Column:
    """ST2: older than `ttl` at `asof`. No time stamp means expired; a ttl of 0 or less never expires."""
    if ttl <= 0:
        return F.lit(False)
    return F.coalesce(asof - last_active > seconds(ttl), F.lit(True))


def too_long(gap: Column, ttl: int) -> Column:
    """Whether a pause ends a session, as 0 or 1."""
    return (gap > seconds(ttl)).cast("int") if ttl > 0 else F.lit(0)


def evict(live: DataFrame, stored: DataFrame, asof: Column, ttl: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST3, U-4: (live left, stored left, one-row count of removed sessions).

    An expired live session takes its stored copy with it and counts once.
    Both sides hold one row per session.
    """
    gone_live = live.where(is_expired(F.col("last_active"), asof, ttl)).select("session_id")
    stored_rest = stored.join(gone_live, "session_id", "left_anti")
    expired_stored = is_expired(F.col("last_active"), asof, ttl)
    removed = gone_live.unionByName(stored_rest.where(expired_stored).select("session_id")).agg(F.count(F.lit(1)).alias("removed"))
    return live.join(gone_live, "session_id", "left_anti"), stored_rest.where(~expired_stored), removed


def sessionize(events: DataFrame, key: str, ts: str, order: str, ttl: int = TTL_SECONDS, width: str = "1 hour") -> DataFrame:
    """ST5: add `session_no` (from 1): a new session starts where the gap to the key's previous event exceeds `ttl`.

    One key may own most of the events, so no window runs over a whole key:
    gaps are found inside (key, time slice) groups of `width`; per slice only
    its edges and number of starts go on to a window over the key's slices,
    which hands each slice the last time and session number before it.
    Events without key or time belong to no session.
    """
    slice_ = F.window(ts, width)["start"]
    inner = Window.partitionBy(key, "slice").orderBy(ts, order)
    before = F.lag(ts).over(inner)
    starts = F.when(before.isNotNull(), too_long(F.col(ts) - before, ttl)).otherwise(0)
    known = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())  # said up front, so that both uses below share one shuffle
    flagged = known.withColumn("slice", slice_).where(F.col("slice").isNotNull()).withColumn("starts", starts)
    edges = flagged.groupBy(key, "slice").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.sum("starts").alias("n_starts"))
    across = Window.partitionBy(key).orderBy("slice")
    previous = F.lag("last").over(across)
    opens = F.when(previous.isNotNull(), too_long(F.col("first") - previous, ttl)).otherwise(1)
    totals = edges.withColumn("opens", opens).select(
        key, "slice",
        (F.sum(F.col("n_starts") + F.col("opens")).over(across) - F.col("n_starts")).alias("at_start"))
    running = F.sum("starts").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        flagged.withColumn("running", running).join(totals, [key, "slice"])
        .withColumn("session_no", F.col("at_start") + F.col("running"))
        .drop("slice", "starts", "running", "at_start")
    )


def session_table(sessionized: DataFrame, key: str, ts: str) -> DataFrame:
    return sessionized.groupBy(key, "session_no").agg(
        F.min(ts).alias("started"), F.max(ts).alias("last_active"), F.count(F.lit(1)).alias("turns"))


def chat_context(turns: DataFrame, key: str = "conv_id", order: str = "turn", max_turns: int = CONTEXT_TURNS) -> DataFrame:
    """The last 2 x `max_turns` messages of each session as `role: text` lines.

    The rank filter reaches the map side as a group limit, so a task sends at
    most that many rows of a session, however long it is.
    """
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    recent = turns.withColumn("back", newest).where(F.col("back") <= 2 * max_turns)
    said = F.struct(F.col(order).alias("o"), F.concat("role", F.lit(": "), "text").alias("said"))
    return recent.groupBy(key).agg(F.array_sort(F.collect_list(said)).alias("said")).select(
        key, F.array_join(F.transform("said", lambda s: s["said"]), "\n").alias("history"))


def turn_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Messages per session, both roles."""
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("turns"))


def history(turns: DataFrame, sessions: DataFrame, asof: Column, ttl: int = TTL_SECONDS, session_id=None) -> DataFrame:
    """ST6: the turns of sessions that have not expired; of one session if an id is given."""
    alive = sessions.where(~is_expired(F.col("last_active"), asof, ttl)).select("session_id")
    if session_id is not None:
        alive, turns = alive.where(F.col("session_id") == session_id), turns.where(F.col("session_id") == session_id)
    return turns.join(alive, "session_id", "left_semi")


def merged(live: DataFrame, stored: DataFrame) -> DataFrame:
    """J9, U-3: live(session_id, last_active, message_count) over stored(session_id, last_active).

    Live wins; a missing time is filled from the store; stored-only sessions count 0 messages.
    """
    l, s = live.alias("l"), stored.alias("s")
    return l.join(s, F.col("l.session_id") == F.col("s.session_id"), "full_outer").select(
        F.coalesce("l.session_id", "s.session_id").alias("session_id"),
        F.coalesce("l.last_active", "s.last_active").alias("last_active"),
        F.col("l.session_id").isNotNull().alias("in_memory"),
        F.coalesce("l.message_count", F.lit(0).cast("bigint")).alias("message_count"))


def resolve(requests: DataFrame, live: DataFrame, stored: DataFrame, asof: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Where each requested session comes from: live, stored, or new if there is none or it expired."""
    l = live.select("session_id", F.col("last_active").alias("live_at"), F.lit(True).alias("is_live"))
    s = stored.select("session_id", F.col("last_active").alias("stored_at"), F.lit(True).alias("is_stored"))
    found = requests.join(l, "session_id", "left").join(s, "session_id", "left")
    at = F.when(F.col("is_live"), F.col("live_at")).otherwise(F.col("stored_at"))
    kept = (F.col("is_live").isNotNull() | F.col("is_stored").isNotNull()) & ~is_expired(at, asof, ttl)
    origin = F.when(~kept, "new").when(F.col("is_live"), "live").otherwise("stored")
    return found.select(*requests.columns, origin.alias("origin"), F.when(kept, at).alias("last_active"))


def upsert(base: DataFrame, updates: DataFrame, key: str = "session_id", order: str = "last_active") -> DataFrame:
    """Base with the updates written over it; of several updates of a key the latest stays.

    A grouped maximum, so rows combine before the shuffle. Write the result to
    a new location: the inputs are still being read.
    """
    rest = [c for c in base.columns if c != key]
    both = base.withColumn("__write", F.lit(0)).unionByName(updates.withColumn("__write", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct("__write", order)).alias("last")
    return both.groupBy(key).agg(last).select(key, "last.*")


def delete(base: DataFrame, keys: DataFrame, key: str = "session_id") -> DataFrame:
    """A18."""
    return base.join(keys.select(key), key, "left_anti")


def listing(sessions: DataFrame) -> DataFrame:
    """A23."""
    return sessions.select("session_id", "last_active")
