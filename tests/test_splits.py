from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowferry.sources.splits import HASHES, equal_splits, read_splits, split_of


def held(df, splits):
    """Rows per split, and whether each row is in one only."""
    found = df.select(split_of(splits).alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in found)
    return Counter(r["s"][0] for r in found)


def skewed(spark, kind, rows=4000):
    choice = random.Random(4)
    day = dt.datetime(2024, 1, 1, 5, 6, 7, 89)
    make = {
        "bigint": lambda n: n * 1_000_003,
        "double": lambda n: n / 7,
        "decimal(12,2)": lambda n: Decimal(n) / 4,
        "date": lambda n: (day + dt.timedelta(days=n)).date(),
        "timestamp_ntz": lambda n: day + dt.timedelta(seconds=n * 37, microseconds=n),
    }[kind]
    # A third of all rows has one value, a tenth another, a tenth none.
    values = [choice.choice([5] * 10 + [9] * 3 + [None] * 3 + [choice.randrange(400) for _ in range(14)]) for _ in range(rows)]
    return spark.createDataFrame([(i, None if v is None else make(v)) for i, v in enumerate(values)], f"id bigint, v {kind}")


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(12,2)", "date", "timestamp_ntz"])
@pytest.mark.parametrize("splits", [1, 7, 40])
def test_disjoint_complete_and_even(spark, kind, splits):
    df = skewed(spark, kind)
    plan = equal_splits(df, "v", splits, "id")
    found = held(df, plan)
    some = 4000 - df.where("v IS NULL").count()
    mean = some / splits
    assert sum(found.values()) == 4000 and sum(s.rows for s in plan) == 4000
    assert max(found.values()) <= 2 * mean and max(s.rows for s in plan) <= 1.5 * mean + 1
    assert len([s for s in plan if "IS NULL" not in s.predicate]) <= splits
    for number, s in enumerate(plan):
        if "xxhash64" not in s.predicate:
            assert found[number] == s.rows == df.where(s.predicate).count()
        if number > 6:
            break


def test_rows_that_come_later_are_held(spark):
    df = skewed(spark, "bigint")
    plan = equal_splits(df, "v", 9, "id")
    later = spark.createDataFrame([(-1, -(2**60)), (-2, 2**60), (None, None), (None, 5 * 1_000_003), (-3, 5 * 1_000_003 + 1)], df.schema)
    assert sum(held(later, plan).values()) == 5


def test_values_no_sketch_can_tell_apart(spark):
    # Above 2**53 neighbouring integers fall together in double precision.
    df = spark.range(3000).select("id", (F.lit(2**60) + F.col("id") % 40).alias("v"))
    found = held(df, equal_splits(df, "v", 10, "id"))
    assert sum(found.values()) == 3000 and max(found.values()) <= 600


def test_edges(spark):
    empty = spark.createDataFrame([], "id bigint, v int")
    assert sum(s.rows for s in equal_splits(empty, "v", 4, "id")) == 0
    assert sum(held(spark.createDataFrame([(1, 3), (2, None)], empty.schema), equal_splits(empty, "v", 4, "id")).values()) == 2
    nulls = spark.range(100).select("id", F.lit(None).cast("int").alias("v"))
    assert sum(held(nulls, equal_splits(nulls, "v", 4, "id")).values()) == 100
    numbers = spark.createDataFrame([(i, x) for i, x in enumerate([float("nan"), float("-inf"), float("inf"), -0.0, 0.0, 1e300, 1.5] * 30)], "id bigint, v double")
    assert sum(held(numbers, equal_splits(numbers, "v", 4, "id")).values()) == 210
    with pytest.raises(ValueError, match="neither"):
        equal_splits(spark.createDataFrame([(1, "a")], "id bigint, v string"), "v", 4, "id")
    with pytest.raises(ValueError, match="identifier"):
        equal_splits(empty, "v", 4, "id; drop")


def test_predicates_of_other_engines(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("v"))
    for dialect, function in {"postgres": "hashtext", "clickhouse": "cityHash64"}.items():
        text = [s.predicate for s in equal_splits(df, "v", 8, "id", dialect)]
        assert any(function in p and ("`v`" if dialect == "clickhouse" else '"v"') in p for p in text)
        assert len({p for p in text if function in p}) == sum(function in p for p in text)
    assert set(HASHES) == {"spark", "postgres", "clickhouse"}

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            return url, table, predicates, properties

    plan = equal_splits(df, "v", 2, "id", "postgres")
    url, table, predicates, rest = read_splits(Reader(), {"url": "u", "dbtable": "t", "user": "me"}, plan)
    assert (url, table, rest) == ("u", "t", {"user": "me"}) and predicates == [s.predicate for s in plan]
