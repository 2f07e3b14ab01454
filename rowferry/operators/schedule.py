"""Next, due and upcoming runs, as expressions over a table of schedules.

All moments are TIMESTAMP_NTZ in UTC. A schedule table has the columns
interval_value, interval_unit ("hours" | "days") and run_at_time ("HH:MM").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT_RUN_AT

VALUE, UNIT, RUN_AT = "interval_value", "interval_unit", "run_at_time"


def moment(value: str | Column) -> Column:
    """A literal or column as TIMESTAMP_NTZ."""
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def whole(a: Column, b: Column | int) -> Column:
    """Integer division, cut towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _is_hours() -> Column:
    return F.col(UNIT) == "hours"


def _step(times: Column) -> Column:
    """``times`` intervals as one day-time interval."""
    n = (F.col(VALUE) * times).cast("int")
    zero = F.lit(0)
    return F.make_dt_interval(F.when(_is_hours(), zero).otherwise(n), F.when(_is_hours(), n).otherwise(zero))


def next_run(anchor: Column) -> Column:
    """The first fire time after ``anchor``.

    Hours count from the anchor. Days fire at run_at_time: today if that is
    still ahead, else so many days later.
    """
    at = F.coalesce(F.when(F.col(RUN_AT) != "", F.col(RUN_AT)), F.lit(DEFAULT_RUN_AT))
    hour, minute = F.split_part(at, F.lit(":"), F.lit(1)).cast("int"), F.split_part(at, F.lit(":"), F.lit(2)).cast("int")
    today = anchor.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)
    one = _step(F.lit(1))
    return F.when(_is_hours(), anchor + one).when(today <= anchor, today + one).otherwise(today)


def skip_forward(anchor: Column, finished: Column) -> Column:
    """The first slot of the schedule after ``finished``.

    After an outage that is one run, not one per missed slot. Once on the
    schedule the slots are evenly spaced, so the number of missed ones is a
    division.
    """
    first = next_run(anchor)
    width = F.when(_is_hours(), F.lit(3_600_000_000)).otherwise(F.lit(86_400_000_000)) * F.col(VALUE).cast("bigint")
    missed = whole(micros(finished) - micros(first), width)
    return F.when(first > finished, first).otherwise(first + _step(missed + 1))


def occurrences(start: Column, days: int) -> Column:
    """All fire times from ``start`` to ``days`` days later, both included, as an array.

    Bounded by the window: one per hour at most.
    """
    if days <= 0:
        return F.array().cast("array<timestamp_ntz>")
    end = start + F.make_dt_interval(F.lit(days))
    second = next_run(start)
    later = F.sequence(second, end, _step(F.lit(1)))
    return F.when(second > end, F.array(start)).otherwise(F.concat(F.array(start), later))


def due(schedules: DataFrame, now: str | Column) -> DataFrame:
    """Active schedules whose time has come."""
    return schedules.where((F.col("status") == "active") & (F.col("next_run") <= moment(now)))


def upcoming(schedules: DataFrame, days: int = 7) -> DataFrame:
    """(sync_id, sync_name, fire_at) of every active schedule for 1..30 days from its next run."""
    if not 1 <= days <= 30:
        raise ValueError("days must be between 1 and 30")
    # There is always a first fire, so the outer form adds no row; the plain one
    # would work out every array twice, once to see that it is not empty.
    return schedules.where((F.col("status") == "active") & F.col("next_run").isNotNull()).select(
        "sync_id",
        F.col("name").alias("sync_name"),
        F.explode_outer(occurrences(F.col("next_run"), days)).alias("fire_at"),
    )


def calendar(fires: DataFrame, now: str, days: int = 7) -> DataFrame:
    """One row per fire time in the next ``days`` days from today, and one for a day without any.

    A day is not gathered into one list: it has as many rows as it has fires.
    """
    today = moment(now).cast("date")
    offset = F.datediff(F.col("fire_at").cast("date"), today)
    inside = fires.select(offset.alias("day_offset"), "fire_at", "sync_id", "sync_name").where(
        F.col("day_offset").between(0, days - 1)
    )
    # At most `days` rows: the busy days are found by a distinct, and the fires
    # themselves are neither joined nor shuffled.
    empty = (
        fires.sparkSession.range(1)
        .select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_offset"))
        .join(inside.select("day_offset").distinct(), "day_offset", "left_anti")
    )
    return inside.unionByName(empty, allowMissingColumns=True).select(
        "day_offset",
        F.date_add(today, F.col("day_offset")).cast("timestamp_ntz").alias("day"),
        (F.col("day_offset") == 0).alias("is_today"),
        "fire_at",
        "sync_id",
        "sync_name",
    )


def rescheduled(schedules: DataFrame, changes: DataFrame, now: str | Column, key: str = "sync_id") -> DataFrame:
    """Schedules with updates applied; next_run moves only where a schedule field was set.

    ``changes`` has the key and any of interval_value, interval_unit,
    run_at_time; null means not set.
    """
    fields = [c for c in (VALUE, UNIT, RUN_AT) if c in changes.columns]
    touched = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = schedules.join(touched, key, "left")
    moved = F.lit(False)
    for c in fields:
        moved = moved | F.col(f"_{c}").isNotNull()
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return joined.withColumn("next_run", F.when(moved, next_run(moment(now))).otherwise(F.col("next_run"))).select(
        *schedules.columns
    )
