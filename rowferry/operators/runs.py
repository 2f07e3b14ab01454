"""Queries over the run history and the spec tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schedule import micros, moment, whole

# Page bounds of a listing, tolerated lateness, days of the chart.
PAGE_DEFAULT, PAGE_MAX = 100, 1000
LATE_AFTER_MICROS = 5 * 60 * 1_000_000
CHART_DAYS = 14

OK_MARK, FAIL_MARK, LATE_MARK = "✅", "❌", "⚠️"


def page(df: DataFrame, *order: Column | str, skip: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """One page of an ordered listing; only skip+limit rows per task leave the map side."""
    if skip < 0 or not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"skip must not be negative, limit must be between 1 and {PAGE_MAX}")
    return df.orderBy(*order).offset(skip).limit(limit)


def history(runs: DataFrame, owner: int | None = None, skip: int = 0, limit: int = PAGE_DEFAULT, owner_column: str = "sync_id") -> DataFrame:
    """Runs newest first, of one owner or of all."""
    if owner is not None:
        runs = runs.where(F.col(owner_column) == owner)
    return page(runs, F.desc("started_at"), F.desc("run_id"), skip=skip, limit=limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("total"))


def with_names(runs: DataFrame, syncs: DataFrame) -> DataFrame:
    """Runs with the name of their sync, or "Pipeline #id" where it is gone.

    No broadcast hint: the planner broadcasts the names while they are small
    and AQE splits a sync with very many runs otherwise.
    """
    names = syncs.select("sync_id", F.col("name").alias("sync_name"))
    shown = F.coalesce("sync_name", F.concat(F.lit("Pipeline #"), F.col("sync_id").cast("string")))
    return runs.join(names, "sync_id", "left").withColumn("shown_name", shown)


def with_labels(runs: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Display names of several references: {"source": frame(source_id, name), …}."""
    for name, frame in lookups.items():
        runs = runs.join(
            frame.select(f"{name}_id", F.col("name").alias(f"{name}_name")), f"{name}_id", "left"
        )
    return runs


def duration_seconds(started: Column, finished: Column) -> Column:
    """Whole seconds, .5 upwards, never negative; null while running."""
    seconds = whole(micros(finished) - micros(started) + 500_000, 1_000_000)
    return F.when(finished.isNotNull(), F.greatest(F.lit(0), seconds))


def daily_outcomes(runs: DataFrame, today: str, days: int = CHART_DAYS) -> DataFrame:
    """(day, success, failed) for each of the last days, also the ones without runs.

    Counted over the whole run table; the date filter reaches the scan.
    """
    last = moment(today).cast("date")
    first = F.date_sub(last, days - 1)
    frame = runs.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    window = (F.col("started_at") >= first.cast("timestamp_ntz")) & (
        F.col("started_at") < F.date_add(last, 1).cast("timestamp_ntz")
    )
    counted = (
        runs.where(window)
        .groupBy(F.col("started_at").cast("date").alias("day"))
        .agg(
            F.count_if(F.col("status") == "success").alias("success"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )
    return frame.join(counted, "day", "left").select(
        F.col("day").cast("timestamp_ntz").alias("day"),
        F.coalesce("success", F.lit(0)).alias("success"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )


def status_distribution(syncs: DataFrame) -> DataFrame:
    return syncs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dashboard_totals(sources: DataFrame, destinations: DataFrame, syncs: DataFrame) -> DataFrame:
    """One row: sources, destinations, syncs and active syncs."""

    def part(df: DataFrame, slot: int, active: Column) -> DataFrame:
        n = F.count(F.lit(1))
        return df.agg(
            *[(n if i == slot else F.lit(0).cast("bigint")).alias(c) for i, c in enumerate(("sources", "destinations", "syncs"))],
            F.coalesce(F.count_if(active), F.lit(0)).alias("active"),
        )

    rows = part(sources, 0, F.lit(False)).unionAll(part(destinations, 1, F.lit(False)))
    rows = rows.unionAll(part(syncs, 2, F.col("status") == "active"))
    return rows.agg(*[F.sum(c).alias(c) for c in ("sources", "destinations", "syncs", "active")])


def listing(df: DataFrame, equal: dict[str, object] | None = None, search: str | None = None, name: str = "name") -> DataFrame:
    """Rows that equal every given value and whose name matches the search."""
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return search_pattern(df, search, name)


def search_pattern(df: DataFrame, term: str | None, column: str = "name") -> DataFrame:
    """Case-insensitive search; ``%`` and ``_`` in the term are wildcards."""
    return df.where(F.col(column).ilike(f"%{term}%")) if term else df


def search_literal(df: DataFrame, term: str | None, column: str = "name") -> DataFrame:
    """Case-insensitive search for the term as it is written; blank finds all."""
    wanted = (term or "").strip().lower()
    return df.where(F.lower(F.col(column)).contains(wanted)) if wanted else df


def delay_text(delay: Column) -> Column:
    """Microseconds as ``3h 10m`` or ``10m``, whole minutes."""
    minutes = whole(delay, 60_000_000)
    hours = whole(minutes, 60)
    rest = F.concat((minutes % 60).cast("string"), F.lit("m"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest)).otherwise(rest)


def lateness(started: Column, due: Column) -> Column:
    """Microseconds past the due time if that is more than tolerated, else null."""
    delay = micros(started) - micros(due)
    return F.when(delay > LATE_AFTER_MICROS, delay)


def late_runs(runs: DataFrame) -> DataFrame:
    """Runs that started more than five minutes after they were due."""
    delay = micros(F.col("started_at")) - micros(F.col("due_at"))
    late = runs.withColumn("late_by", delay).where(F.col("late_by") > LATE_AFTER_MICROS)
    return late.withColumn("late_text", delay_text(F.col("late_by"))).withColumn(
        "due_text", F.date_format("due_at", "HH:mm 'UTC'")
    )


def _mark(ok: Column) -> Column:
    return F.when(ok, OK_MARK).otherwise(FAIL_MARK)


def _failure() -> Column:
    message = F.when(F.col("error_message") != "", F.col("error_message"))
    return F.concat(F.lit("Failed: "), F.coalesce(message, F.lit("unknown error")))


# Fixed texts: the wording of the reports below and of ``_failure``.
def run_reports(runs: DataFrame) -> DataFrame:
    """The report text of each run (name, outcome, lateness) and the written share.

    ``runs`` has sync_name, status, records_read, records_written,
    error_message, started_at and due_at (null for a manual run).
    """
    ok = F.col("status") == "success"
    outcome = F.when(
        ok,
        F.format_string("Read %d / wrote %d records", F.col("records_read"), F.col("records_written")),
    ).otherwise(_failure())
    late = lateness(F.col("started_at"), F.col("due_at"))
    late_line = F.concat(
        F.lit(f"\n{LATE_MARK} Ran "), delay_text(late), F.lit(" late (was due at "),
        F.date_format("due_at", "HH:mm 'UTC'"), F.lit(")"),
    )
    text = F.concat(_mark(ok), F.lit(" <b>"), F.col("sync_name"), F.lit("</b>\n"), outcome, F.coalesce(late_line, F.lit("")))
    share = F.try_divide(F.col("records_written"), F.col("records_read"))
    return runs.withColumn("report", text).withColumn("written_share", share)


def agent_reports(runs: DataFrame) -> DataFrame:
    """The report text of each agent run."""
    ok = F.col("status") == "success"
    outcome = F.when(
        ok,
        F.format_string(
            "Considered %d, selected %d, wrote %d records.",
            F.col("rows_considered"), F.col("rows_selected"), F.col("rows_written"),
        ),
    ).otherwise(_failure())
    return runs.withColumn(
        "report", F.concat(_mark(ok), F.lit(" <b>Agent: "), F.col("agent_name"), F.lit("</b>\n"), outcome)
    )
