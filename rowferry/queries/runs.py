"""Run history, listings and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.timeline import latest_before, most_at_once
from . import standins as S
from .registry import query, table

RUN_COLUMNS = ["run_id", "sync_id", "status", "started_at", "finished_at", "records_read", "records_written"]
_COLUMNS = ", ".join(RUN_COLUMNS)


@query("runs_recent", S.with_ctes(S.RUNS_SQL, body=f"SELECT {_COLUMNS} FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 100 OFFSET 20"))
def runs_recent(spark, folder):
    return R.history(S.runs(spark, folder).select(*RUN_COLUMNS), skip=20)


@query(
    "runs_by_sync",
    S.with_ctes(
        S.RUNS_SQL, body=f"SELECT {_COLUMNS} FROM runs WHERE sync_id = 7 ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 2"
    ),
)
def runs_by_sync(spark, folder):
    return R.history(S.runs(spark, folder).select(*RUN_COLUMNS), owner=7, skip=2, limit=50)


@query("runs_total", S.with_ctes(S.RUNS_SQL, body="SELECT count(*) AS total FROM runs"))
def runs_total(spark, folder):
    return R.total(S.runs(spark, folder))


@query("runs_count_by_sync", S.with_ctes(S.RUNS_SQL, body="SELECT sync_id, count(*) AS total FROM runs GROUP BY 1"))
def runs_count_by_sync(spark, folder):
    return R.counts_by(S.runs(spark, folder), "sync_id")


@query(
    "runs_with_name",
    S.with_ctes(
        S.RUNS_SQL,
        body="""
SELECT run_id, sync_id, c_name AS sync_name, coalesce(c_name, 'Pipeline #' || sync_id) AS shown_name
FROM (SELECT run_id, sync_id * 3 AS sync_id FROM runs) r LEFT JOIN customer ON c_custkey = sync_id""",
    ),
)
def runs_with_name(spark, folder):
    # Two thirds of the owners are gone.
    runs = S.runs(spark, folder).select("run_id", (F.col("sync_id") * 3).alias("sync_id"))
    return R.with_names(runs, S.syncs(spark, folder)).select("run_id", "sync_id", "sync_name", "shown_name")


@query(
    "syncs_with_labels",
    S.with_ctes(
        S.SYNCS_SQL,
        S.SOURCES_SQL,
        S.DESTINATIONS_SQL,
        body="""
SELECT sync_id, s.name, o.name AS source_name, d.name AS destination_name
FROM syncs s LEFT JOIN sources o USING (source_id) LEFT JOIN destinations d USING (destination_id)""",
    ),
)
def syncs_with_labels(spark, folder):
    labels = {"source": S.sources(spark, folder), "destination": S.destinations(spark, folder)}
    return R.with_labels(S.syncs(spark, folder), labels).select("sync_id", "name", "source_name", "destination_name")


@query(
    "run_durations",
    S.with_ctes(
        S.RUNS_SQL,
        body="""
SELECT run_id, CASE WHEN finished_at IS NOT NULL THEN
         greatest(0, CAST(floor((epoch_us(finished_at) - epoch_us(started_at) + 500000) / 1000000) AS BIGINT)) END AS seconds
FROM runs""",
    ),
)
def run_durations(spark, folder):
    seconds = R.duration_seconds(F.col("started_at"), F.col("finished_at"))
    return S.runs(spark, folder).select("run_id", seconds.alias("seconds"))


# Two days after the last event, so that the chart has days without any run.
@query(
    "runs_daily",
    S.with_ctes(
        S.RUNS_SQL,
        body="""
SELECT d.day, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-19', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS day) d
LEFT JOIN runs ON date_trunc('day', started_at) = d.day GROUP BY 1""",
    ),
)
def runs_daily(spark, folder):
    return R.daily_outcomes(S.runs(spark, folder), "2024-02-01 00:00:00")


@query("sync_status", S.with_ctes(S.SYNCS_SQL, body="SELECT status, count(*) AS n FROM syncs GROUP BY 1"))
def sync_status(spark, folder):
    return R.status_distribution(S.syncs(spark, folder))


@query(
    "dashboard_totals",
    S.with_ctes(
        S.SYNCS_SQL,
        S.SOURCES_SQL,
        S.DESTINATIONS_SQL,
        body="""
SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM destinations) AS destinations,
       count(*) AS syncs, count(*) FILTER (status = 'active') AS active FROM syncs""",
    ),
)
def dashboard_totals(spark, folder):
    return R.dashboard_totals(S.sources(spark, folder), S.destinations(spark, folder), S.syncs(spark, folder))


@query(
    "list_filtered",
    S.with_ctes(
        S.SYNCS_SQL,
        body="""
SELECT sync_id, name, source_id, status FROM syncs
WHERE destination_id = 3 AND status = 'active' AND name ILIKE '%CUSTOMER#0%' ORDER BY sync_id LIMIT 100 OFFSET 1""",
    ),
)
def list_filtered(spark, folder):
    found = R.listing(
        S.syncs(spark, folder), {"source_id": None, "destination_id": 3, "mapping_id": None, "status": "active"}, "CUSTOMER#0"
    )
    return R.page(found, "sync_id", skip=1).select("sync_id", "name", "source_id", "status")


@query("list_by_reference", S.with_ctes(S.SYNCS_SQL, body="SELECT sync_id, name FROM syncs WHERE source_id = 42"))
def list_by_reference(spark, folder):
    return R.listing(S.syncs(spark, folder), {"source_id": 42}).select("sync_id", "name")


@query("find_by_name", S.with_ctes(S.SOURCES_SQL, body="SELECT source_id, name, type FROM sources WHERE name = 'Supplier#000000007'"))
def find_by_name(spark, folder):
    return R.listing(S.sources(spark, folder), {"name": "Supplier#000000007"}).select("source_id", "name", "type")


@query("search_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%R_D%W%'")
def search_ilike(spark, folder):
    return R.search_pattern(table(spark, folder, "part").select("p_partkey", "p_name"), "R_D%W", "p_name")


@query("search_literal", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red w')")
def search_literal(spark, folder):
    return R.search_literal(table(spark, folder, "part").select("p_partkey", "p_name"), "  Red W ", "p_name")


@query(
    "search_text",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
)
def search_text(spark, folder):
    return R.search_literal(table(spark, folder, "documents"), "License", "text").select("doc_id")


_DELAY_SQL = "CASE WHEN m >= 60 THEN (m // 60) || 'h ' ELSE '' END || (m % 60) || 'm'"

# Due times up to 4.5 hours before the start.
_LATE_SQL = """
late AS (
  SELECT *, epoch_us(started_at) - epoch_us(due) AS late_by, (epoch_us(started_at) - epoch_us(due)) // 60000000 AS m
  FROM (SELECT *, started_at - to_minutes(records_read % 10 * (run_id % 31)) AS due FROM runs)
  WHERE epoch_us(started_at) - epoch_us(due) > 300000000)"""


@query(
    "late_runs",
    S.with_ctes(
        S.RUNS_SQL,
        _LATE_SQL,
        body=f"SELECT run_id, late_by, {_DELAY_SQL} AS late_text, strftime(due, '%H:%M UTC') AS due_text FROM late",
    ),
)
def late_runs(spark, folder):
    zero = F.lit(0)
    minutes = (F.col("records_read") % 10 * (F.col("run_id") % 31)).cast("int")
    runs = S.runs(spark, folder).withColumn("due_at", F.col("started_at") - F.make_dt_interval(zero, zero, minutes))
    return R.late_runs(runs).select("run_id", "late_by", "late_text", "due_text")


@query(
    "run_reports",
    S.with_ctes(
        S.RUNS_SQL,
        body="""
SELECT run_id,
  CASE WHEN status = 'success' THEN '✅' ELSE '❌' END || ' <b>sync ' || sync_id || '</b>' || chr(10) ||
  CASE WHEN status = 'success' THEN 'Read ' || records_read || ' / wrote ' || records_written || ' records'
       ELSE 'Failed: ' || coalesce(nullif(error_message, ''), 'unknown error') END ||
  CASE WHEN "trigger" = 'scheduled' AND epoch_us(started_at) - epoch_us(due_at) > 300000000
       THEN chr(10) || '⚠️ Ran ' || (epoch_us(started_at) - epoch_us(due_at)) // 60000000 || 'm late (was due at ' || strftime(due_at, '%H:%M UTC') || ')'
       ELSE '' END AS report,
  records_written / records_read AS written_share
FROM runs""",
    ),
)
def run_reports(spark, folder):
    runs = S.runs(spark, folder).withColumn("sync_name", F.concat(F.lit("sync "), F.col("sync_id").cast("string")))
    runs = runs.withColumn("due_at", F.when(F.col("trigger") == "scheduled", F.col("due_at")))
    return R.run_reports(runs).select("run_id", "report", "written_share")


@query(
    "agent_reports",
    """
SELECT event_id AS run_id,
  CASE WHEN event_type <> 'error' THEN '✅' ELSE '❌' END || ' <b>Agent: a' || user_id || '</b>' || chr(10) ||
  CASE WHEN event_type <> 'error' THEN 'Considered ' || (2 * k) || ', selected ' || k || ', wrote ' || (k // 2) || ' records.'
       ELSE 'Failed: ' || coalesce(CASE WHEN k % 2 = 0 THEN 'model is off' END, 'unknown error') END AS report
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""",
)
def agent_reports(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    runs = table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("agent_name"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        (2 * k).alias("rows_considered"),
        k.alias("rows_selected"),
        F.floor(k / 2).alias("rows_written"),
        F.when(failed & (k % 2 == 0), "model is off").alias("error_message"),
    )
    return R.agent_reports(runs).select("run_id", "report")


@query(
    "runs_served_slot",
    S.with_ctes(
        S.RUNS_SQL,
        """
slots AS (SELECT DISTINCT sync_id, due_at FROM runs WHERE "trigger" = 'scheduled')""",
        body="""SELECT r.run_id, r.sync_id, s.due_at AS slot_at, epoch_us(r.started_at) - epoch_us(s.due_at) AS late_us
FROM runs r ASOF LEFT JOIN slots s ON r.sync_id = s.sync_id AND r.started_at >= s.due_at""",
    ),
)
def runs_served_slot(spark, folder):
    """The slot each run serves: the latest one of its sync that was due at its start. Slots are told by the scheduled runs."""
    runs = S.runs(spark, folder)
    slots = runs.where(F.col("trigger") == "scheduled").select("sync_id", F.col("due_at").alias("slot_at"))
    served = latest_before(runs.select("run_id", "sync_id", "started_at"), slots, ["sync_id"], "started_at", "slot_at", "slot")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return served.select("run_id", "sync_id", F.col("slot.slot_at").alias("slot_at"), (us("started_at") - us("slot.slot_at")).alias("late_us"))


# The oracle counts the runs that are open at the start of each run: pairs of runs.
@query(
    "runs_concurrency",
    S.with_ctes(
        S.RUNS_SQL,
        """
r AS (SELECT sync_id % 10 AS source_id, started_at AS a, finished_at AS b FROM runs WHERE finished_at IS NULL OR finished_at > started_at)""",
        body="""SELECT source_id, max(n) AS most, min_by(a, (-n, a)) AS first_at
FROM (SELECT x.source_id, x.a, count(*) AS n FROM (SELECT DISTINCT source_id, a FROM r) x
      JOIN r y ON y.source_id = x.source_id AND y.a <= x.a AND (y.b > x.a OR y.b IS NULL) GROUP BY ALL) GROUP BY source_id""",
    ),
)
def runs_concurrency(spark, folder):
    """The greatest number of runs at one time per source; a run that has not finished is open."""
    runs = S.runs(spark, folder).withColumn("source_id", F.col("sync_id") % 10)
    return most_at_once(runs, ["source_id"], "started_at", "finished_at")
