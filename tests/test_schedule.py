from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowferry.operators import schedule as T

D = datetime


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, interval_value int, interval_unit string, run_at_time string, anchor timestamp_ntz",
    )


@pytest.mark.parametrize(
    "value, unit, run_at, anchor, expected",
    [
        (3, "hours", None, D(2026, 1, 1, 9), D(2026, 1, 1, 12)),
        (1, "days", "09:00", D(2026, 1, 1, 6), D(2026, 1, 1, 9)),
        (1, "days", "09:00", D(2026, 1, 1, 12), D(2026, 1, 2, 9)),
        (3, "days", "09:00", D(2026, 1, 1, 12), D(2026, 1, 4, 9)),
        (1, "days", None, D(2026, 1, 1, 6), D(2026, 1, 1, 9)),
        (1, "days", "09:00", D(2026, 1, 1, 9), D(2026, 1, 2, 9)),
    ],
)
def test_next(spark, value, unit, run_at, anchor, expected):
    assert frame(spark, [(value, unit, run_at, anchor)]).select(T.next_run(F.col("anchor"))).first()[0] == expected


def cases(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        unit = rnd.choice(["hours", "days"])
        run_at = rnd.choice([None, "00:00", "23:59", f"{rnd.randrange(24):02}:{rnd.randrange(60):02}"])
        anchor = D(2024, 2, 20) + timedelta(seconds=rnd.randrange(30 * 86_400), microseconds=rnd.choice([0, 1, 999_999]))
        yield rnd.randint(1, 168 if unit == "hours" else 90), unit, run_at, anchor


def on_grid(slot, value, unit, run_at, anchor):
    """Whether a schedule may fire at ``slot``."""
    if unit == "hours":
        steps = (slot - anchor) / timedelta(hours=value)
        return steps >= 0 and steps == int(steps)
    time_of_day = run_at or "09:00"
    return slot.strftime("%H:%M") == time_of_day and (slot.second, slot.microsecond) == (0, 0)


def test_skip_forward_finds_the_first_slot_behind(spark):
    rnd = random.Random(5)
    rows = list(cases(800, 5))
    ends = [(i, row[3] + timedelta(seconds=rnd.randrange(-86_400, 86_400 * 40))) for i, row in enumerate(rows)]
    df = frame(spark, rows).join(spark.createDataFrame(ends, "i int, e timestamp_ntz"), "i")
    first = F.col("anchor")
    found = df.select("i", "e", T.skip_forward(first, F.col("e")).alias("n"), T.next_run(first).alias("one")).collect()
    for r in found:
        value, unit, run_at, anchor = rows[r.i]
        step = timedelta(**{unit: value})
        assert r.n > r.e and r.n > anchor and on_grid(r.n, value, unit, run_at, anchor)
        # Whole steps behind the first slot, and none of them lies between the end and the slot found.
        assert (r.n - r.one) % step == timedelta(0) and r.n >= r.one
        assert r.n == r.one or r.n - step <= r.e


@pytest.mark.parametrize("days", [1, 7, 30])
def test_occurrences_are_the_whole_grid(spark, days):
    rows = list(cases(300, days))
    found = frame(spark, rows).select("i", T.occurrences(F.col("anchor"), days).alias("f"), T.next_run(F.col("anchor")).alias("one"))
    for r in found.collect():
        value, unit, run_at, start = rows[r.i]
        end, step = start + timedelta(days=days), timedelta(**{unit: value})
        assert r.f[0] == start and all(slot <= end for slot in r.f)
        if r.one > end:
            assert r.f == [start]
            continue
        assert r.f[1] == r.one and all(b - a == step for a, b in zip(r.f[1:], r.f[2:])) and r.f[-1] + step > end
        assert all(on_grid(slot, value, unit, run_at, start) for slot in r.f[1:])


@pytest.mark.parametrize("value, unit, days, n", [(6, "hours", 1, 5), (1, "days", 7, 8), (1, "days", 0, 0)])
def test_number_of_occurrences(spark, value, unit, days, n):
    df = frame(spark, [(value, unit, "09:00", D(2026, 1, 1, 9))])
    assert len(df.select(T.occurrences(F.col("anchor"), days)).first()[0]) == n


def schedules(spark):
    return spark.createDataFrame(
        [
            (1, "a", "active", 1, "days", "09:00", D(2026, 1, 1, 9)),
            (2, "b", "active", 12, "hours", None, D(2026, 1, 1, 10)),
            (3, "c", "paused", 1, "hours", None, D(2026, 1, 1, 8)),
            (4, "d", "active", 1, "hours", None, None),
            (5, "e", "active", 1, "days", "09:00", D(2027, 1, 1, 9)),
        ],
        "sync_id int, name string, status string, interval_value int, interval_unit string, run_at_time string, next_run timestamp_ntz",
    )


def test_due(spark):
    assert [r.sync_id for r in T.due(schedules(spark), "2026-01-01 09:00:00").collect()] == [1]


def test_upcoming_and_calendar(spark):
    fires = T.upcoming(schedules(spark), 7)
    assert {r.sync_id for r in fires.collect()} == {1, 2, 5}
    rows = T.calendar(fires, "2025-12-31 20:00:00").collect()
    by_day = {}
    for r in rows:
        by_day.setdefault(r.day_offset, []).append(r.sync_id)
    assert by_day[0] == [None] and sorted(by_day[1]) == [1, 2, 2] and set(by_day) == set(range(7))
    assert [r.is_today for r in rows if r.day_offset == 0] == [True]
    for days in (0, 31):
        with pytest.raises(ValueError):
            T.upcoming(schedules(spark), days)


def test_reschedule(spark):
    changes = spark.createDataFrame([(1, None, "10:30"), (2, None, None)], "sync_id int, interval_value int, run_at_time string")
    rows = {r.sync_id: r for r in T.rescheduled(schedules(spark), changes, "2026-03-01 00:00:00").collect()}
    assert rows[1].next_run == D(2026, 3, 1, 10, 30) and rows[1].run_at_time == "10:30"
    assert rows[2].next_run == D(2026, 1, 1, 10) and rows[4].next_run is None
