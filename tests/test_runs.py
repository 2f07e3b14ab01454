from __future__ import annotations

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from rowferry.operators import runs as R

SCHEMA = (
    "run_id long, sync_id long, sync_name string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, "
    "due_at timestamp_ntz, records_read long, records_written long, error_message string"
)


@pytest.fixture(scope="module")
def runs(spark):
    noon = D(2026, 1, 1, 12, 10)
    rows = [
        (1, 1, "a", "success", noon, D(2026, 1, 1, 12, 10, 2, 500_000), D(2026, 1, 1, 9), 10, 8, None),
        (2, 1, "a", "failed", noon, D(2026, 1, 1, 12, 9), D(2026, 1, 1, 12, 8), 4, 0, "boom"),
        (3, 2, "b", "failed", D(2026, 1, 3), D(2026, 1, 3), None, 0, 0, None),
        (4, 9, "c", "running", D(2026, 1, 3), None, D(2026, 1, 2, 23, 55), 0, 0, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_reports(runs):
    texts = [r.report for r in R.run_reports(runs).orderBy("run_id").collect()]
    assert texts == [
        "✅ <b>a</b>\nRead 10 / wrote 8 records\n⚠️ Ran 3h 10m late (was due at 09:00 UTC)",
        "❌ <b>a</b>\nFailed: boom",
        "❌ <b>b</b>\nFailed: unknown error",
        "❌ <b>c</b>\nFailed: unknown error",
    ]
    shares = [r.written_share for r in R.run_reports(runs).orderBy("run_id").collect()]
    assert shares == [0.8, 0.0, None, None]


def test_late(runs):
    assert [(r.run_id, r.late_text, r.due_text) for r in R.late_runs(runs).collect()] == [(1, "3h 10m", "09:00 UTC")]


def test_agent_reports(spark):
    df = spark.createDataFrame(
        [("x", "success", 9, 3, 2, None), ("y", "failed", 0, 0, 0, "off")],
        "agent_name string, status string, rows_considered long, rows_selected long, rows_written long, error_message string",
    )
    assert [r.report for r in R.agent_reports(df).collect()] == [
        "✅ <b>Agent: x</b>\nConsidered 9, selected 3, wrote 2 records.", "❌ <b>Agent: y</b>\nFailed: off",
    ]


def test_durations(runs):
    seconds = runs.select("run_id", R.duration_seconds(F.col("started_at"), F.col("finished_at")).alias("s"))
    assert [r.s for r in seconds.orderBy("run_id").collect()] == [3, 0, 0, None]


def test_daily(runs):
    rows = R.daily_outcomes(runs, "2026-01-04 15:00:00").orderBy("day").collect()
    assert len(rows) == 14 and rows[0].day == D(2025, 12, 22)
    assert {r.day.day: (r.success, r.failed) for r in rows if r.success or r.failed} == {1: (1, 1), 3: (0, 1)}


def test_names(spark, runs):
    syncs = spark.createDataFrame([(1, "one"), (2, "two")], "sync_id long, name string")
    found = R.with_names(runs.drop("sync_name"), syncs).orderBy("run_id").collect()
    assert [r.shown_name for r in found] == ["one", "one", "two", "Pipeline #9"]


def test_history(runs):
    assert [r.run_id for r in R.history(runs).collect()] == [4, 3, 2, 1]
    assert [r.run_id for r in R.history(runs, owner=1, skip=1, limit=1).collect()] == [1]
    assert R.total(runs).first().total == 4
    for wrong in ({"limit": 0}, {"limit": 1001}, {"skip": -1}):
        with pytest.raises(ValueError):
            R.history(runs, **wrong)


def test_search(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("Red_Hat",), ("redXhat",)], "name string")
    names = lambda x: sorted(r.name for r in x.collect())
    assert names(R.search_pattern(df, "50%")) == ["50% off", "500 off"]
    assert names(R.search_literal(df, " 50% ")) == ["50% off"]
    assert names(R.search_pattern(df, "d_h")) == ["Red_Hat", "redXhat"]
    assert names(R.search_literal(df, "D_H")) == ["Red_Hat"]
    assert len(names(R.search_literal(df, "  "))) == len(names(R.search_pattern(df, ""))) == 4


def test_totals(spark):
    syncs = spark.createDataFrame([("active",), ("paused",), ("active",)], "status string")
    row = R.dashboard_totals(spark.range(5), spark.range(0), syncs).first()
    assert tuple(row) == (5, 0, 3, 2)
    assert {r.status: r.n for r in R.status_distribution(syncs).collect()} == {"active": 2, "paused": 1}
