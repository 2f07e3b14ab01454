from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowferry.sources.daily import DISTINCT_BOUND, FREQUENT_BOUND, RANK_BOUND, DailyProfiles, merge_days, profile_days
from rowferry.sources.profile import profile

SCHEMA = "day date, name string, amount double, number int, at timestamp_ntz, flag boolean"


def rows(days, per_day=3000):
    choice = random.Random(11)
    out = []
    for d in range(days):
        day = dt.date(2024, 3, 1) + dt.timedelta(days=d)
        for _ in range(per_day):
            name = choice.choice(["hot"] * 3 + ["warm", None] + [f"n{choice.randrange(900)}" for _ in range(4)])
            amount = choice.choice([None, float("nan"), choice.gauss(10 * d, 5), choice.gauss(10 * d, 5), choice.gauss(10 * d, 5)])
            out.append((day, name, amount, choice.choice([None, choice.randrange(50)]), dt.datetime(2024, 3, 1, d), choice.random() < 0.2))
    return out


def test_merged_days_against_counting(spark, tmp_path):
    data = rows(6)
    df = spark.createDataFrame(data, SCHEMA)
    stored = DailyProfiles(spark, str(tmp_path / "profiles"))
    stored.add(df.where("day < '2024-03-06'"), "day")
    stored.add(df.where("day = '2024-03-06'"), "day")
    for first, last in [(None, None), (dt.date(2024, 3, 2), dt.date(2024, 3, 4)), (dt.date(2024, 3, 6), None)]:
        mine = [r for r in data if (first is None or r[0] >= first) and (last is None or r[0] <= last)]
        found = {r["column_name"]: r for r in stored.merged(first, last, shares=(0.1, 0.5, 0.9)).collect()}
        assert set(found) == {"name", "amount", "number", "at", "flag"}
        same = profile(spark.createDataFrame(mine, SCHEMA).drop("day"))
        exact = {r["column_name"]: tuple(r)[1:] for r in same.collect()}
        for column, r in found.items():
            assert repr(tuple(r)[1:8]) == repr(exact[column])  # rows, nulls and bounds are not approximate
        names = Counter(r[1] for r in mine if r[1] is not None)
        assert abs(found["name"]["approx_distinct"] - len(names)) <= DISTINCT_BOUND * len(names)
        listed = {x["item"]: x["count"] for x in found["name"]["frequent"]}
        assert {"hot", "warm"} <= set(listed) and None not in listed and len(listed) <= 5
        assert all(names[k] <= n <= names[k] + FREQUENT_BOUND * len(mine) for k, n in listed.items())
        amounts = sorted(r[2] for r in mine if r[2] is not None and r[2] == r[2])
        for share, value in zip((0.1, 0.5, 0.9), found["amount"]["quantiles"]):
            below, upto = sum(a < value for a in amounts), sum(a <= value for a in amounts)
            assert below / len(amounts) <= share + RANK_BOUND and upto / len(amounts) >= share - RANK_BOUND
        assert found["name"]["quantiles"] is None


def test_a_day_again_replaces_it(spark, tmp_path):
    df = spark.createDataFrame(rows(3, 50), SCHEMA)
    stored = DailyProfiles(spark, str(tmp_path / "profiles"))
    stored.add(df, "day")
    stored.add(df.where("day = '2024-03-02'").limit(20), "day")
    counts = {r["day"]: r["n_rows"] for r in stored.days().where("column_name = 'name'").collect()}
    assert counts == {dt.date(2024, 3, 1): 50, dt.date(2024, 3, 2): 20, dt.date(2024, 3, 3): 50}


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    stored = DailyProfiles(spark, str(tmp_path / "profiles"))
    with pytest.raises(FileNotFoundError):
        stored.merged()
    stored.add(spark.createDataFrame(rows(3, 20), SCHEMA), "day")
    plan = stored.days(dt.date(2024, 3, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_nulls_and_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merge_days(profile_days(empty, "day")).count() == 0
    nulls = spark.createDataFrame([(None,) * 6, (None, "", None, None, None, None)], SCHEMA)
    found = {r["column_name"]: r for r in merge_days(profile_days(nulls, "day")).collect()}
    assert (found["amount"]["n_null"], found["amount"]["quantiles"], found["amount"]["frequent"], found["amount"]["approx_distinct"]) == (2, None, [], 0)
    assert [tuple(x) for x in found["name"]["frequent"]] == [("", 1)] and found["name"]["approx_distinct"] == 1


def test_one_small_row_per_task_and_day_is_moved(spark):
    df = spark.range(1000).select(F.lit(dt.date(2024, 1, 1)).alias("day"), F.col("id").alias("v"))
    plan = profile_days(df, "day")._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "partial_kllsketchaggdouble" in plan.lower().replace("_", "").replace("partial", "partial_")
    assert plan.count("Exchange") == 1
