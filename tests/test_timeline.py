from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowferry.operators.timeline import latest_before, most_at_once


def at(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture(params=[(1, 10_000), (8, 7), (8, 1)], ids=["one part", "eight parts", "rows alone"])
def session(spark, request):
    """Few rows over many partitions, in small batches: groups begin, end and go on in all places."""
    partitions, batch = request.param
    made = spark.newSession()
    made.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made.conf.set("spark.sql.shuffle.partitions", str(partitions))
    made.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    return made


def test_latest_before_against_all_pairs(session):
    choice = random.Random(1)
    # Group 1 has most of all rows and, for a long stretch, no slot.
    group = lambda: choice.choice([1] * 6 + [2, 3, None])
    left = [(i, group(), choice.choice(["a", "b"]), at(choice.choice([None] + list(range(300))))) for i in range(250)]
    left += [(900 + i, 1, "a", at(150)) for i in range(40)] + [left[0]]
    right = [(choice.choice([1, 2, None]), choice.choice(["a", "b"]), at(choice.choice([None, *range(0, 40), *range(250, 290)])), f"s{i}") for i in range(60)]
    a = session.createDataFrame(left, "id int, g int, h string, t timestamp_ntz")
    b = session.createDataFrame(right, "g int, h string, due timestamp_ntz, name string")
    found = latest_before(a, b, ["g", "h"], "t", "due").collect()

    def brute(row):
        fits = [s for s in right if None not in s and row[1:3] == s[:2] and row[3] is not None and s[2] <= row[3]]
        return max(fits, key=lambda s: (s[2], s[3]), default=None)

    assert found[0].asDict().keys() == {"id", "g", "h", "t", "latest"}
    mine = sorted((str(tuple(r)[:4]), str(None if r["latest"] is None else tuple(r["latest"]))) for r in found)
    assert mine == sorted((str(r), str(brute(r))) for r in left)
    assert latest_before(a, b.where(F.lit(False)), ["g", "h"], "t", "due").where("latest IS NOT NULL").count() == 0
    assert latest_before(a.where(F.lit(False)), b, ["g", "h"], "t", "due").count() == 0


def test_most_at_once_against_counting(session):
    choice = random.Random(2)
    rows = []
    for _ in range(400):
        start = choice.choice([None] + list(range(500)))
        rows.append((choice.choice([1] * 6 + [2, 3, None]), at(start), at(choice.choice([None, 0] + [(start or 0) + d for d in range(0, 60, 5)]))))
    df = session.createDataFrame(rows, "g int, a timestamp_ntz, b timestamp_ntz")
    expected = {}
    good = [r for r in rows if r[1] is not None and (r[2] is None or r[2] > r[1])]
    for g in {r[0] for r in good}:
        mine = [r for r in good if r[0] == g]
        counts = [(-sum(a <= t and (b is None or b > t) for _, a, b in mine), t) for _, t, _ in mine]
        most, first = min(counts)
        expected[g] = (-most, first)
    found = {r["g"]: (r["most"], r["first_at"]) for r in most_at_once(df, ["g"], "a", "b").collect()}
    assert found == expected
    assert most_at_once(df.where("g = 99"), ["g"], "a", "b").count() == 0


def test_one_group_is_many_tasks(session, spark):
    """A plan without a window or a join over the rows of a group."""
    df = spark.range(10).select(F.lit(1).alias("g"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("a"), F.lit(None).cast("timestamp_ntz").alias("b"))
    plan = most_at_once(df, ["g"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(grp" in plan and plan.index("Window") < plan.index("MapInArrow") < plan.index("rangepartitioning")
