"""Profiles that are kept per day as sketches and merged for any range of days.

A stored row is one column's profile of one day: counts and bounds, which merge exactly, and three binary
sketches of bounded size: distinct values (HyperLogLog), quantiles (KLL) and frequent values. A
range of days is profiled from these rows alone; a new day is one pass over that day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exists

# Counters of a HyperLogLog, as a power of two: the relative standard error is 1.04 / 2**(LG_K / 2), 1.6 %.
LG_K = 12
# Of a KLL sketch of this size the rank of a quantile is off by 0.35 % of the rows at most in 99 of 100 cases.
KLL_K = 800
# Values told apart by a sketch of frequent ones. It holds 2048 counters, so a count is at most 3.5 / 2048 of the rows too high
# and every value with twice that share is listed.
TRACKED = 1000
# What a merged profile is held to: relative error of distinct counts (four standard errors), error in
# rank of quantiles, error of frequent counts as a share of the rows.
DISTINCT_BOUND, RANK_BOUND, FREQUENT_BOUND = 0.065, 0.01, 3.5 / 2048


def _frequent(function: str, *arguments: str) -> Column:
    return F.expr(f"{function}({', '.join(arguments)})")


def _scalar(df: DataFrame, day: str) -> list[T.StructField]:
    kinds = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return [f for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name != day]


def profile_days(df: DataFrame, day: str) -> DataFrame:
    """The stored form: (``day``, column_name, ...), a row per day and scalar column.

    One pass with partial aggregation: of each task, a row with its sketches leaves per day, however many rows the day has.
    Null days are a day of their own. Numbers have quantiles, NaN and null left out; all columns have distinct and frequent
    values, taken as text. A column without values has null bounds and quantiles.
    """
    fields = _scalar(df, day)
    measures = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        measures += [F.count(c).alias(f"v{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        # The sketch passes over empty texts, so none is.
        measures.append(F.hll_sketch_agg(F.concat(F.lit("="), c.cast("string")), LG_K).alias(f"d{i}"))
        measures.append(_frequent("approx_top_k_accumulate", f"CAST(`{f.name}` AS STRING)", str(TRACKED)).alias(f"f{i}"))
        if isinstance(f.dataType, T.NumericType):
            number = c.cast("double")
            measures.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_K).alias(f"q{i}"))

    def row(i: int, f: T.StructField) -> Column:
        numeric = isinstance(f.dataType, T.NumericType)
        number = lambda c: F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        words = lambda c: F.lit(None).cast("string") if numeric else F.col(c).cast("string")
        return F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"v{i}")).alias("n_null"),
            number(f"lo{i}").alias("min_number"),
            number(f"hi{i}").alias("max_number"),
            words(f"lo{i}").alias("min_text"),
            words(f"hi{i}").alias("max_text"),
            F.col(f"d{i}").alias("distinct_sketch"),
            (F.col(f"q{i}") if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"),
            F.col(f"f{i}").alias("frequent_sketch"),
        )

    rows = F.array(*[row(i, f) for i, f in enumerate(fields)])
    return df.groupBy(F.col(f"`{day}`").alias("day")).agg(*measures).select("day", F.inline(rows))


def merge_days(stored: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """One row per column of the days given: n_rows, n_null and bounds, all exact, and from the sketches
    ``approx_distinct``, ``quantiles`` (of ``shares``, null without numbers) and ``frequent`` (item, count), most frequent first, without null.

    Reads stored rows only. A column that is missing on some days counts the rows of the others.
    """
    merged = stored.groupBy("column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"),
        F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"),
        F.hll_union_agg("distinct_sketch").alias("d"),
        F.kll_merge_agg_double("quantile_sketch").alias("q"),
        _frequent("approx_top_k_combine", "frequent_sketch", str(TRACKED)).alias("f"),
    )
    numbers = F.kll_sketch_get_n_double("q") > 0
    quantiles = F.when(numbers, F.kll_sketch_get_quantile_double("q", F.array(*[F.lit(float(s)) for s in shares])))
    return merged.select(
        "column_name", "data_type", "n_rows", "n_null", "min_number", "max_number", "min_text", "max_text",
        F.hll_sketch_estimate("d").alias("approx_distinct"), quantiles.alias("quantiles"),
        F.slice(F.filter(_frequent("approx_top_k_estimate", "f", str(top + 1)), lambda x: x["item"].isNotNull()), 1, top).alias("frequent"),
    )


class DailyProfiles:
    """Stored profiles of one table, a folder per day; a day that is profiled again replaces its old row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, day: str) -> None:
        """Profile the days in ``df``, each of which has to be whole. Other days stay as they are."""
        rows = profile_days(df, day)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def days(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The stored rows from ``first`` to ``last``, both included; only their folders are read."""
        if not exists(self.spark, self.path):
            raise FileNotFoundError(f"no profiles in {self.path}")
        rows = self.spark.read.parquet(self.path)
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first))
        return rows if last is None else rows.where(F.col("day") <= F.lit(last))

    def merged(self, first: dt.date | None = None, last: dt.date | None = None, **options) -> DataFrame:
        return merge_days(self.days(first, last), **options)
