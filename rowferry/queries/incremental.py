"""Incremental windows and watermarks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..sources.incremental import newer_than, next_watermark
from .registry import query, table

LAST = datetime(2000, 1, 1)


@query("incremental_full", "SELECT o_orderkey, o_orderdate FROM orders")
def incremental_full(spark, folder):
    return newer_than(table(spark, folder, "orders"), "o_orderdate", None).select("o_orderkey", "o_orderdate")


@query(
    "incremental_delta",
    """
SELECT o_orderkey, changed_at
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS changed_at FROM orders)
WHERE changed_at > TIMESTAMP '2000-01-01 00:00:00'
""",
)
def incremental_delta(spark, folder):
    # Some rows have no value in the field: a delta never reads them.
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("changed_at")
    )
    return newer_than(orders, "changed_at", LAST)


@query(
    "incremental_delta_pushed",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01 00:00:00'",
)
def incremental_delta_pushed(spark, folder):
    return newer_than(table(spark, folder, "orders"), "o_orderdate", LAST).select("o_orderkey", "o_custkey", "o_orderdate")


@query(
    "incremental_inclusive",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00')",
)
def incremental_inclusive(spark, folder):
    events = table(spark, folder, "events")
    # What an earlier run has read ends at its watermark, which is read again.
    earlier = events.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    last = next_watermark(earlier, "ts").first()["watermark"]
    return newer_than(events, "ts", last, inclusive=True).select("event_id", "ts")


@query(
    "watermark_next",
    "SELECT count(*) AS rows_read, max(ts) AS watermark FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'",
)
def watermark_next(spark, folder):
    return next_watermark(newer_than(table(spark, folder, "events"), "ts", datetime(2024, 1, 10, 12)), "ts")
