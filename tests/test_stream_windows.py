from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from rowferry.streaming import accounted, closed_until, run_windows, streaks
from rowferry.streaming.windows import MERGE_EARLY

SCHEMA = "run int, sync string, at timestamp_ntz"
START = dt.datetime(2024, 5, 1)


def feed(spark, tmp_path, arrivals, make):
    """The stream's result after each arrival, written and read, and where it stands in the end."""
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(files)
        result = make(spark.readStream.schema(SCHEMA).parquet(files))
        writer = result.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = writer.trigger(availableNow=True).start(out)
        query.awaitTermination()
        seen.append(spark.read.schema(result.schema).parquet(out).collect())
    return spark.read.schema(SCHEMA).parquet(files), spark.read.schema(result.schema).parquet(out), seen, closed_until(query)


def test_every_row_is_on_time_late_or_open(spark, tmp_path):
    choice = random.Random(5)
    at = lambda low, high: START + dt.timedelta(minutes=choice.randrange(low, high))
    key = lambda: choice.choice(["hot"] * 4 + ["a", None])
    arrivals = [
        [(i, key(), at(0, 600)) for i in range(200)] + [(999, "a", START + dt.timedelta(minutes=600)), (998, "a", None)],
        # Some of these come after their window was closed; a sync that was never seen before as well.
        [(i, key(), at(0, 1200)) for i in range(200, 400)] + [(997, "new", START), (996, "a", START + dt.timedelta(minutes=1200))],
        [(i, key(), at(300, 1500)) for i in range(400, 500)] + [(995, "a", START + dt.timedelta(minutes=1500))],
    ]
    make = lambda stream: run_windows(stream, "at", "60 minutes", "2 hours", [F.count(F.lit(1)).alias("n")], ("sync",))
    history, windows, seen, until = feed(spark, tmp_path, arrivals, make)
    assert until == START + dt.timedelta(minutes=1380)
    marks = [START - dt.timedelta(days=1), START + dt.timedelta(minutes=480), START + dt.timedelta(minutes=1080)]
    expected: dict = {}
    for rows, mark in zip(arrivals, marks):
        for _, sync, time in rows:
            if time is not None:
                window = time.replace(minute=0)
                end = window + dt.timedelta(hours=1)
                tally = expected.setdefault((sync, window), [0, 0, 0])
                tally[2 if end > until else 1 if end <= mark else 0] += 1
    found = accounted(history, windows, "at", "60 minutes", until, by=("sync",)).collect()
    assert {(r["sync"], r["window_start"]): [r["n_on_time"], r["n_late"], r["n_open"]] for r in found} == expected
    assert len(found) == len(expected) and expected[("new", START)] == [0, 1, 0]
    assert sum(r["n"] for r in seen[-1]) == sum(v[0] for v in expected.values()) > 0 and sum(v[1] for v in expected.values()) > 50
    # What has been written stays as it was.
    assert set(map(tuple, seen[0])) <= set(map(tuple, seen[1])) <= set(map(tuple, seen[2]))
    open_only = accounted(history, windows.where(F.lit(False)), "at", "60 minutes", None, by=("sync",))
    assert open_only.agg(F.sum("n_open"), F.sum("n_late")).first()[:] == (504, 0)


def test_streaks_against_walking(spark, tmp_path):
    session = spark.newSession()
    session.conf.set(MERGE_EARLY, "true")
    choice = random.Random(6)
    rows = [(i, choice.choice(["hot"] * 5 + ["a", "b", None]), START + dt.timedelta(minutes=choice.randrange(0, 6000))) for i in range(260)]
    rows.sort(key=lambda r: r[2])
    make = lambda stream: streaks(stream, "at", "90 minutes", "3 hours", ("sync",))
    _, _, seen, until = feed(session, tmp_path, [rows[:120], rows[120:200], rows[200:]], make)
    gap, expected = dt.timedelta(minutes=90), []
    for sync in {r[1] for r in rows}:
        walked: list = []
        for time in (r[2] for r in rows if r[1] == sync):
            if walked and time - walked[-1][1] < gap:
                walked[-1][1:] = [time, walked[-1][2] + 1]
            else:
                walked.append([time, time, 1])
        expected += [(sync, *w) for w in walked if w[1] + gap <= until]
    mine = sorted((str(tuple(r)) for r in seen[-1]))
    assert mine == sorted(map(str, expected)) and len(mine) > 30


def test_nothing_and_no_times(spark, tmp_path):
    make = lambda stream: run_windows(stream, "at", "1 hour", "1 hour", [F.count(F.lit(1)).alias("n")])
    history, windows, seen, until = feed(spark, tmp_path, [[(1, "a", None)]], make)
    assert seen == [[]] and accounted(history, windows, "at", "1 hour", until).count() == 0
