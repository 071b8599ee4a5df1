"""Streams: direct replies as an interval join, activity windows, sessions and adjacent responses with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(comments: DataFrame, lateness: str) -> DataFrame:
    """comments with ts, the time of created_utc, and a watermark: rows later than `lateness` may be dropped by operators with
    state, so results equal the batch ones only if nothing is later."""
    return comments.where("created_utc > 0").withColumn("ts", F.timestamp_seconds("created_utc")).withWatermark("ts", lateness)


def stream_direct_replies(comments: DataFrame, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Replies by another author within `seconds` of the comment they answer; state is kept for that time and the lateness."""
    child = with_event_time(comments, lateness).select(F.col("author").alias("child_author"), F.col("id").alias("child_comment_id"), F.col("parent"), F.col("created_utc").alias("child_utc"), F.col("ts").alias("child_ts"))
    parent = with_event_time(comments, lateness).select(F.col("author").alias("parent_author"), F.col("id").alias("parent_comment_id"), F.col("created_utc").alias("parent_utc"), F.col("ts").alias("parent_ts"))
    near = F.expr(f"parent = parent_comment_id AND child_ts >= parent_ts AND child_ts < parent_ts + INTERVAL {seconds + 1} SECONDS")
    both = child.join(parent, near).withColumn("delta_seconds", (F.col("child_utc") - F.col("parent_utc")).cast("int"))
    return both.where((F.col("child_author") != F.col("parent_author")) & F.col("delta_seconds").between(0, seconds)).select("child_author", "parent_author", "parent_comment_id", "child_comment_id", "delta_seconds")


def stream_counts(comments: DataFrame, key: str, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """(key, start, n) per window of event time."""
    by = with_event_time(comments, lateness).groupBy(key, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.unix_timestamp("w.start").alias("start_utc"), "n")


def stream_sessions(comments: DataFrame, gap: int = 1800, lateness: str = "1 day") -> DataFrame:
    """(author, start_utc, end_utc, n): sessions that the watermark has closed. A window of gap seconds and a microsecond makes
    events exactly gap apart share a session, as in the batch operator."""
    by = with_event_time(comments, lateness).groupBy("author", F.session_window("ts", f"{gap} seconds 1 microsecond").alias("w"))
    return by.agg(F.min("created_utc").alias("start_utc"), F.max("created_utc").alias("end_utc"), F.count(F.lit(1)).alias("n")).select("author", F.floor("start_utc").alias("start_utc"), F.floor("end_utc").alias("end_utc"), "n")


def stream_adjacent(comments: DataFrame, seconds: int, lateness: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """(thread, previous_author, author, delta_seconds): within a thread each comment that follows another author's within seconds,
    for streams whose comments come in order of time; the state is a thread's last comment, dropped once the watermark is
    idle seconds past it."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["created_utc", "id"])
        before, then = rows["author"].shift(), rows["created_utc"].shift()
        if last is not None:
            before.iat[0], then.iat[0] = last
        delta = (rows["created_utc"] - then).fillna(-1.0)
        near = before.notna() & (before != rows["author"]) & (delta > -1) & (delta < seconds + 1)
        last = (rows["author"].iat[-1], float(rows["created_utc"].iat[-1]))
        state.update(last)
        state.setTimeoutTimestamp(max(int((last[1] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"thread": key[0], "previous_author": before, "author": rows["author"], "delta_seconds": delta.astype("int32")})[near]

    rows = with_event_time(comments, lateness).where("thread IS NOT NULL AND author IS NOT NULL").select("thread", "author", "created_utc", "id", "ts")
    return rows.groupBy("thread").applyInPandasWithState(follow, "thread string, previous_author string, author string, delta_seconds int", "author string, created_utc double", "append", GroupStateTimeout.EventTimeTimeout)
