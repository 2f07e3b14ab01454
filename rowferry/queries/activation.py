"""Whole runs, batch and streaming, into a file sink below the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators.selection import score_weighted
from ..operators.upsert import record_calls
from ..operators.mapping import resolve
from ..plans.activation import run_agent, run_sync
from ..session import staging_path
from ..sinks.files import FileSink
from ..sources.incremental import newer_than
from ..spec import AgentSpec, FieldMap, SyncSpec
from ..streaming import ParquetTable, VersionLog, accounted, closed_until, deduplicate, newest_versions, polled, run_windows, streaks, stream_sync
from ..streaming.versions import ROCKSDB
from ..streaming.windows import MERGE_EARLY
from .registry import SCHEMAS, query, table

ORDERS = SyncSpec(
    sync_id=1,
    name="orders to deals",
    field_mappings=(
        FieldMap("o_orderkey", "ID"),
        FieldMap("o_orderpriority", "TITLE", "lowercase"),
        FieldMap("o_custkey", "CONTACT_ID", "to_string"),
        FieldMap("o_orderdate", "CLOSED", "parse_date"),
    ),
    destination_type="bitrix24",
    entity="deal",
    incremental_field="o_orderdate",
    last_run=datetime(2000, 6, 1),
    key_columns=("o_orderkey",),
)

# Order key 0 is no id for this destination, so that order is a create.
_DEALS_SQL = """
SELECT CASE WHEN o_orderkey <> 0 THEN 'update' ELSE 'create' END AS op,
       'crm.deal.' || CASE WHEN o_orderkey <> 0 THEN 'update' ELSE 'add' END AS method,
       '{' || CASE WHEN o_orderkey <> 0 THEN '"id":' || o_orderkey || ',' ELSE '' END || '"fields":{"TITLE":"' || lower(o_orderpriority) ||
       '","CONTACT_ID":"' || o_custkey || '","CLOSED":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}}' AS payload
FROM orders"""


@query("activate_orders", _DEALS_SQL + " WHERE o_orderdate > TIMESTAMP '2000-06-01 00:00:00'")
def activate_orders(spark, folder):
    """The lazy core of a sync: window, mapping, payload."""
    orders = newer_than(table(spark, folder, "orders"), ORDERS.incremental_field, ORDERS.last_run)
    return record_calls(orders, resolve(orders, ORDERS.field_mappings), "deal").drop("unsendable")


@query("run_sync_files", _DEALS_SQL + " WHERE o_orderdate > TIMESTAMP '2000-06-01 00:00:00'")
def run_sync_files(spark, folder):
    """The whole run: what the sink holds afterwards."""
    sink = FileSink(staging_path(spark, "deals"))
    row = run_sync(table(spark, folder, "orders"), ORDERS, sink, run_id="r1")
    if row["status"] != "success":
        raise RuntimeError(row["error_message"])
    return spark.read.parquet(f"{sink.path}/run=r1").select("op", "method", "payload")


@query(
    "run_agent_files",
    """
SELECT 'update' AS op, '{"id":' || c_custkey || ',"name":"' || c_name || '"}' AS payload
FROM customer WHERE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE + c_acctbal / 10000 * 1.0::DOUBLE)) >= 0.6::DOUBLE
""",
)
def run_agent_files(spark, folder):
    spec = AgentSpec(
        agent_id=1,
        name="good payers",
        goal="offer credit",
        actions="call",
        field_mappings=(FieldMap("c_custkey", "id"), FieldMap("c_name", "name")),
        destination_type="amocrm",
        entity="contacts",
        status="ready",
        selection_rule="high balance",
        key_columns=("c_custkey",),
    )
    sink = FileSink(staging_path(spark, "contacts"), type="amocrm")
    score = lambda df: score_weighted(df, [(F.col("c_acctbal") / 10000, 1.0)])
    row = run_agent(table(spark, folder, "customer"), spec, score, sink, row_key="c_custkey", run_id="r1")
    if row["status"] != "success":
        raise RuntimeError(row["error_message"])
    return spark.read.parquet(f"{sink.path}/run=r1").select("op", "payload")


EVENTS = SyncSpec(
    sync_id=2,
    name="events to contacts",
    field_mappings=(
        FieldMap("user_id", "ID"),
        FieldMap("event_type", "LAST_EVENT", "uppercase"),
        FieldMap("event_id", "EVENT"),
    ),
    destination_type="bitrix24",
    entity="contact",
    incremental_field="ts",
    key_columns=("event_id",),
)

_LAST_EVENTS_SQL = """
SELECT 'update' AS op, 'crm.contact.update' AS method,
       '{"id":' || user_id || ',"fields":{"LAST_EVENT":"' || upper(event_type) || '","EVENT":' || event_id || '}}' AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND user_id <> 0
UNION ALL
SELECT 'create', 'crm.contact.add', '{"fields":{"LAST_EVENT":"' || upper(event_type) || '","EVENT":' || event_id || '}}'
FROM events WHERE user_id = 0
"""


@query("stream_upsert", _LAST_EVENTS_SQL)
def stream_upsert(spark, folder):
    """events as a file stream: the last event of each user reaches the contact.

    User 0 is no id for this destination: each of its events is a create, and
    creates are not collapsed.
    """
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{folder}/events*.parquet")
    sink = FileSink(staging_path(spark, "stream"))
    stream_sync(stream, EVENTS, sink, staging_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(sink.path).select("op", "method", "payload")


@query("stream_late_versions", _LAST_EVENTS_SQL)
def stream_late_versions(spark, folder):
    """The newer half of the events comes first, the older half later: no contact goes back."""
    events = table(spark, folder, "events")
    split = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    newer = F.unix_micros(F.col("ts").cast("timestamp")) > F.lit(split)
    files, checkpoint = staging_path(spark, "late"), staging_path(spark, "stream-checkpoint")
    sink, versions = FileSink(staging_path(spark, "stream")), VersionLog(spark, staging_path(spark, "versions"))
    for half in (newer, ~newer):
        events.where(half).write.mode("append").parquet(files)
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(files)
        stream_sync(stream, EVENTS, sink, checkpoint, versions=versions).awaitTermination()
    return spark.read.parquet(sink.path).select("op", "method", "payload")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, folder):
    """Every event arrives twice, in two files, and leaves once."""
    events = table(spark, folder, "events")
    files, out, checkpoint = staging_path(spark, "twice"), staging_path(spark, "once"), staging_path(spark, "once-checkpoint")
    for _ in range(2):
        events.write.mode("append").parquet(files)
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(files)
        # The delay covers the whole table, so no event comes too late to be known.
        once = deduplicate(stream, ["event_id"], "ts", "20000 days").select("event_id", "user_id")
        writer = once.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


_VERSIONS_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(hour(ts) AS INTEGER) AS at_hour, epoch_us(ts) AS us FROM events),
b AS (SELECT min(us) AS low, max(us) AS high FROM e),
one AS (SELECT e.* FROM e, b WHERE us > low + (high - low) // 2
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type, at_hour ORDER BY us DESC) = 1),
two AS (SELECT e.* FROM e ANTI JOIN one USING (user_id, event_type, at_hour), b
        WHERE us > high // 1000 * 1000 - 20 * 86400000000::BIGINT
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type, at_hour ORDER BY us DESC) = 1)
SELECT event_id, user_id, event_type, at_hour FROM one UNION ALL SELECT event_id, user_id, event_type, at_hour FROM two"""


@query("stream_state_versions", _VERSIONS_SQL)
def stream_state_versions(spark, folder):
    """A record per user, type and hour. The newer half comes first, then all events: of a record that was sent nothing
    goes out again, of the others the last event, unless it is over 20 days behind."""
    # The state store is a setting of the session; this query has one of its own.
    spark = spark.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = table(spark, folder, "events").withColumn("at_hour", F.hour("ts"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    files, out, checkpoint = staging_path(spark, "versions"), staging_path(spark, "newest"), staging_path(spark, "state")
    for arrived in (events.where(us > low + (high - low) // 2), events) if low is not None else (events,):
        arrived.write.mode("append").parquet(files)
        stream = spark.readStream.schema(events.schema).parquet(files)
        newest = newest_versions(stream, ["user_id", "event_type", "at_hour"], "ts", "20 days")
        writer = newest.select("event_id", "user_id", "event_type", "at_hour").writeStream.format("parquet")
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, at_hour int").parquet(out)


@query("stream_polled", "SELECT event_id, user_id, date_trunc('hour', ts) AS stamp FROM events")
def stream_polled(spark, folder):
    """Events with the hour as their time, polled after each of three arrivals that end amid the rows of an hour."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("stamp"))
    us = F.unix_micros(F.col("stamp").cast("timestamp"))
    cuts = []
    for (hour,) in events.groupBy().agg(F.explode(F.percentile_approx(us, [0.33, 0.66])).alias("hour")).collect():
        middle = events.where(us == hour).agg(F.percentile_approx("event_id", 0.5)).first()[0]
        cuts.append((us < hour) | ((us == hour) & (F.col("event_id") <= middle)))
    files, out, checkpoint = staging_path(spark, "polled"), staging_path(spark, "polls"), staging_path(spark, "poll")
    for arrived in (cuts[0], cuts[1] & ~cuts[0], ~cuts[1]):
        events.where(arrived).write.mode("append").parquet(files)
        stream = polled(spark, ParquetTable(files, "stamp", "event_id"), events.schema, "polled_events")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


# Two thirds or so of the runs come first: those up to the middle of the time, but for every tenth. All others come later.
_ARRIVALS_SQL = """
e AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us FROM events),
m AS (SELECT min(us) + (max(us) - min(us)) // 2 AS middle, max(us) // 1000 * 1000 - 86400000000::BIGINT AS mark FROM e),
w AS (SELECT e.*, e.us // 21600000000 * 21600000000 + 21600000000 AS ends, event_id % 10 <> 0 AND us <= middle AS first, mark FROM e, m),
f AS (SELECT max(us) // 1000 * 1000 - 86400000000::BIGINT AS mark FROM w WHERE first)"""


def _arrivals(spark, folder):
    """The runs in two arrivals."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    if low is None:
        return events, [events]
    first = (F.col("event_id") % 10 != 0) & (us <= low + (high - low) // 2)
    return events, [events.where(first), events.where(~first)]


@query(
    "stream_run_windows",
    f"""
WITH {_ARRIVALS_SQL}
SELECT make_timestamp(ends - 21600000000) AS window_start,
       CAST(count(*) FILTER (ends <= w.mark AND (first OR ends > f.mark)) AS BIGINT) AS n_on_time,
       CAST(count(*) FILTER (ends <= w.mark AND NOT first AND ends <= f.mark) AS BIGINT) AS n_late,
       CAST(count(*) FILTER (ends > w.mark) AS BIGINT) AS n_open,
       CASE WHEN count(*) FILTER (ends <= w.mark AND (first OR ends > f.mark)) > 0
            THEN CAST(count(*) FILTER (ends <= w.mark AND (first OR ends > f.mark) AND event_type = 'error') AS BIGINT) END AS n_failed
FROM w, f GROUP BY ends""",
)
def stream_run_windows(spark, folder):
    """Runs per six hours, closed a day later. Every tenth run of the first half comes with the second: most of these are late."""
    events, arrivals = _arrivals(spark, folder)
    files, out, checkpoint = staging_path(spark, "runs"), staging_path(spark, "windows"), staging_path(spark, "windows-checkpoint")
    failed = F.count(F.when(F.col("event_type") == "error", 1)).alias("n_failed")
    for arrived in arrivals:
        arrived.write.mode("append").parquet(files)
        stream = spark.readStream.schema(events.schema).parquet(files)
        counted = run_windows(stream, "ts", "6 hours", "1 day", [F.count(F.lit(1)).alias("n"), failed])
        writer = counted.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        running = writer.trigger(availableNow=True).start(out)
        running.awaitTermination()
    windows = spark.read.schema(counted.schema).parquet(out)
    told = accounted(spark.read.schema(events.schema).parquet(files), windows, "ts", "6 hours", closed_until(running))
    return told.join(windows.select("window_start", "n_failed"), "window_start", "left")


@query(
    "stream_failure_streaks",
    """
WITH e AS (SELECT user_id, ts, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
m AS (SELECT max(us) // 1000 * 1000 - 86400000000::BIGINT AS mark FROM e),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 172800000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS streak FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n
FROM s, m GROUP BY user_id, streak, mark HAVING max(us) + 172800000000 <= mark""",
)
def stream_failure_streaks(spark, folder):
    """Failed runs of each sync with less than two days between them, in two arrivals by time; streaks that are over."""
    spark = spark.newSession()
    spark.conf.set(MERGE_EARLY, "true")
    failed = table(spark, folder, "events").where("event_type = 'error'").select("user_id", "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = failed.agg(F.percentile_approx(us, 0.5)).first()[0]
    files, out, checkpoint = staging_path(spark, "failed"), staging_path(spark, "streaks"), staging_path(spark, "streaks-checkpoint")
    for arrived in (failed,) if middle is None else (failed.where(us <= middle), failed.where(us > middle)):
        arrived.write.mode("append").parquet(files)
        stream = spark.readStream.schema(failed.schema).parquet(files)
        found = streaks(stream, "ts", "2 days", "1 day", ("user_id",))
        writer = found.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
