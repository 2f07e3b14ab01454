"""Runs counted as they come in: event-time windows, streaks of failures, and what came too late for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Merges sessions of one task before the shuffle, so a sync with most failures leaves each task as a few rows.
MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With the event time as a TIMESTAMP, which watermarks need; a column without a zone is read in the session's."""
    return stream.withColumn("_event_time", F.col(f"`{time}`").cast("timestamp")).withWatermark("_event_time", delay)


def run_windows(stream: DataFrame, time: str, length: str, delay: str, measures: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., window_start, window_end, measures..): one row per window of event time, once it is ``delay`` in the past.

    For append mode. Rows of a window are combined in each task before they are dealt; state is a row per open window. A row
    that comes in after its window has been closed is in none (see ``accounted``); rows without a time are in no window.
    """
    held = F.window("_event_time", length)
    counted = _timed(stream, time, delay).groupBy(*by, held.alias("w")).agg(*measures)
    kind = stream.schema[time].dataType
    rest = [c for c in counted.columns if c not in ("w", *by)]
    return counted.select(*by, F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), *rest)


def streaks(stream: DataFrame, time: str, gap: str, delay: str, by: tuple[str, ...]) -> DataFrame:
    """(by.., first_at, last_at, n): stretches of rows of one key with less than ``gap`` from one to the next, once they
    have been over for ``delay``. For append mode; give it the failed runs, and a streak is what an alarm is about."""
    event = F.col(f"`{time}`")
    sessions = _timed(stream, time, delay).groupBy(*by, F.session_window("_event_time", gap).alias("w"))
    return sessions.agg(F.min(event).alias("first_at"), F.max(event).alias("last_at"), F.count(F.lit(1)).alias("n")).drop("w")


def closed_until(query: StreamingQuery) -> datetime | None:
    """The watermark a stopped or running query has reached, in UTC without a zone: windows that end there or before are closed."""
    progress = query.lastProgress
    mark = (progress or {}).get("eventTime", {}).get("watermark")
    return None if mark is None else datetime.fromisoformat(mark.replace("Z", "+00:00")).replace(tzinfo=None)


def accounted(history: DataFrame, windows: DataFrame, time: str, length: str, until: datetime | None, n: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., window_start, n_on_time, n_late, n_open) of all windows that ``history`` has rows in.

    ``windows`` is what ``run_windows`` has written, with a count ``n``; ``until`` what ``closed_until`` said. Rows of closed windows are on
    time if the stream counted them, else late; rows of other windows are open. The three add up to the rows
    with a time. Null keys are keys.
    """
    moment = F.window(F.col(f"`{time}`").cast("timestamp"), length)
    kind = history.schema[time].dataType
    there = history.groupBy(*by, moment.alias("w")).agg(F.count(F.lit(1)).alias("_rows")).select(
        *by, F.col("w.start").cast(kind).alias("window_start"), F.unix_micros("w.end").alias("_end"), "_rows"
    )
    keys = (*by, "window_start")
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"h.`{key}`").eqNullSafe(F.col(f"s.`{key}`"))
    stored = windows.select(*keys, F.col(n).alias("_stored"))
    mark = F.lit(None).cast("timestamp") if until is None else F.to_timestamp(F.lit(f"{until.isoformat(' ')}+00:00"))
    closed = F.coalesce(F.col("_end") <= F.unix_micros(mark), F.lit(False))
    on_time = F.coalesce(F.col("_stored"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    return there.alias("h").join(stored.alias("s"), same, "left").select(
        *[F.col(f"h.`{key}`") for key in keys],
        F.when(closed, on_time).otherwise(zero).alias("n_on_time"),
        F.when(closed, F.col("_rows") - on_time).otherwise(zero).alias("n_late"),
        F.when(closed, zero).otherwise(F.col("_rows")).alias("n_open"),
    )
