"""Schedule arithmetic over the schedules derived from customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schedule as T
from . import standins as S
from .registry import query

NOW = S.NOW
_NOW_SQL = f"TIMESTAMP '{NOW}'"

# The first fire time after an anchor, as SQL over interval_value, interval_unit and run_at_time.
_TODAY = (
    "date_trunc('day', {a}) + to_hours(CAST(split_part(coalesce(run_at_time, '09:00'), ':', 1) AS INT))"
    " + to_minutes(CAST(split_part(coalesce(run_at_time, '09:00'), ':', 2) AS INT))"
)


def _next(a: str) -> str:
    today = _TODAY.format(a=a)
    return (
        f"CASE WHEN interval_unit = 'hours' THEN {a} + to_hours(interval_value)"
        f" WHEN {today} <= {a} THEN {today} + to_days(interval_value) ELSE {today} END"
    )


_ANCHOR = f"coalesce(next_run, {_NOW_SQL})"
_STEP = "CASE WHEN interval_unit = 'hours' THEN to_hours(interval_value) ELSE to_days(interval_value) END"


@query("schedule_next", S.with_ctes(S.SYNCS_SQL, body=f"SELECT sync_id, {_next(_ANCHOR)} AS next_run FROM syncs"))
def schedule_next(spark, folder):
    anchor = F.coalesce("next_run", T.moment(NOW))
    return S.syncs(spark, folder).select("sync_id", T.next_run(anchor).alias("next_run"))


# The oracle walks from slot to slot; the outage ends 20 days later.
@query(
    "schedule_skip_forward",
    "WITH RECURSIVE"
    + S.SYNCS_SQL
    + f"""
, slots AS (
  SELECT sync_id, interval_value, interval_unit, {_next(_ANCHOR)} AS slot FROM syncs
  UNION ALL
  SELECT sync_id, interval_value, interval_unit, slot + {_STEP} FROM slots WHERE slot <= TIMESTAMP '2024-02-20 10:17:00')
SELECT sync_id, max(slot) AS next_run FROM slots GROUP BY 1""",
)
def schedule_skip_forward(spark, folder):
    anchor = F.coalesce("next_run", T.moment(NOW))
    finished = T.moment("2024-02-20 10:17:00")
    return S.syncs(spark, folder).select("sync_id", T.skip_forward(anchor, finished).alias("next_run"))


def _fires_sql(days: int, where: str) -> str:
    return f"""
, firsts AS (SELECT sync_id, name, interval_value, interval_unit, next_run AS s, {_next('next_run')} AS n FROM syncs WHERE {where})
, fires AS (
  SELECT sync_id, name AS sync_name, s AS fire_at FROM firsts
  UNION ALL
  SELECT sync_id, name, unnest(generate_series(n, s + to_days({days}), {_STEP})) FROM firsts WHERE n <= s + to_days({days}))"""


@query(
    "schedule_occurrences",
    "WITH" + S.SYNCS_SQL + _fires_sql(3, "next_run IS NOT NULL") + "\nSELECT sync_id, fire_at FROM fires",
)
def schedule_occurrences(spark, folder):
    known = S.syncs(spark, folder).where("next_run IS NOT NULL")
    return known.select("sync_id", F.explode_outer(T.occurrences(F.col("next_run"), 3)).alias("fire_at"))


@query(
    "due_syncs",
    S.with_ctes(S.SYNCS_SQL, body=f"SELECT sync_id, next_run FROM syncs WHERE status = 'active' AND next_run <= {_NOW_SQL}"),
)
def due_syncs(spark, folder):
    return T.due(S.syncs(spark, folder), NOW).select("sync_id", "next_run")


_ACTIVE = "status = 'active' AND next_run IS NOT NULL"


@query("upcoming_runs", "WITH" + S.SYNCS_SQL + _fires_sql(7, _ACTIVE) + "\nSELECT * FROM fires")
def upcoming_runs(spark, folder):
    return T.upcoming(S.syncs(spark, folder))


# "Today" is the day before the first fires, so the first day of the calendar is empty.
@query(
    "upcoming_calendar",
    "WITH"
    + S.SYNCS_SQL
    + _fires_sql(7, _ACTIVE)
    + """
SELECT CAST(o AS INT) AS day_offset, TIMESTAMP '2024-01-29' + to_days(CAST(o AS INT)) AS day, o = 0 AS is_today, fire_at, sync_id, sync_name
FROM (SELECT unnest(range(7)) AS o) d LEFT JOIN fires ON date_trunc('day', fire_at) = TIMESTAMP '2024-01-29' + to_days(CAST(o AS INT))""",
)
def upcoming_calendar(spark, folder):
    return T.calendar(T.upcoming(S.syncs(spark, folder)), "2024-01-29 18:00:00")


@query(
    "schedule_reschedule",
    S.with_ctes(
        S.SYNCS_SQL,
        body=f"""
, changed AS (
  SELECT sync_id, CASE WHEN sync_id % 3 = 1 THEN 5 ELSE interval_value END AS interval_value, interval_unit,
         CASE WHEN sync_id % 3 = 2 THEN '06:15' ELSE run_at_time END AS run_at_time, sync_id % 3 <> 0 AS moved, next_run AS old
  FROM syncs)
SELECT sync_id, interval_value, run_at_time, CASE WHEN moved THEN {_next(_NOW_SQL)} ELSE old END AS next_run FROM changed""",
    ),
)
def schedule_reschedule(spark, folder):
    schedules = S.syncs(spark, folder)
    key = F.col("sync_id")
    changes = schedules.select(
        "sync_id", F.when(key % 3 == 1, 5).alias("interval_value"), F.when(key % 3 == 2, "06:15").alias("run_at_time")
    )
    moved = T.rescheduled(schedules, changes, NOW)
    return moved.select("sync_id", "interval_value", "run_at_time", "next_run")
