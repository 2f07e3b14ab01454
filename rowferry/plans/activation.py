"""One run of a sync or of a selection agent."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.mapping import Record, quoted, resolve
from ..operators.schedule import moment, skip_forward
from ..operators.selection import select_rows, selection_summary
from ..operators.upsert import UPDATE, batch_op, collapse, idempotency_key, record_id, record_op
from ..session import stage
from ..sinks.delivery import Delivered, DeliveryError
from ..sources.incremental import WatermarkLog, newer_than, next_watermark
from ..spec import AgentSpec, SyncSpec
from .log import RunLog


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def window(source: DataFrame, field: str | None, last: object | None) -> tuple[DataFrame, str | None]:
    """The rows of this run and the watermark after it, as text.

    The upper end is looked up first and the read is closed there. Rows that
    arrive meanwhile lie above it and come with the next run, so the
    watermark never runs ahead of what was read.
    """
    rows = newer_than(source, field, last)
    if not field:
        return rows, None
    highest = next_watermark(rows, field).select(F.col("watermark").cast("string")).first()[0]
    if highest is None:
        # Nothing new: what arrives from now on belongs to the next run.
        return (rows if last is None else rows.where(F.lit(False))), None
    closed = F.col(f"`{field}`") <= F.lit(highest).cast(source.schema[field].dataType)
    if last is None:
        closed = closed | F.col(f"`{field}`").isNull()
    return rows.where(closed), highest


def identity(record: Record, destination_type: str) -> Column | None:
    """What tells two versions of one record: its id as text, so that ids of any type can be
    compared; null for a create. None if every record is a create."""
    text = lambda c: F.to_json(F.struct(c.alias("id")))
    if destination_type == "bitrix24":
        known = "ID" in record or "id" in record
        return F.when(record_op(record) == UPDATE, text(record_id(record))) if known else None
    if batch_op(record) != UPDATE:
        return None
    return F.when(record.column("id").isNotNull(), text(record.column("id")))


def used_columns(rows: DataFrame, spec: SyncSpec | AgentSpec, *more: str) -> DataFrame:
    """The columns a run goes on with: mapped ones, those that order versions, and ``more``."""
    wanted = {spec.incremental_field, *spec.key_columns, *more, *(m.source_field for m in spec.field_mappings)}
    return rows.select(*(quoted(c) for c in rows.columns if c in wanted))


def collapses(rows: DataFrame, spec: SyncSpec | AgentSpec) -> bool:
    """Whether versions of one record will be brought together."""
    ordered = bool(spec.incremental_field or spec.key_columns)
    return ordered and identity(resolve(rows, spec.field_mappings), spec.destination_type) is not None


def prepare(rows: DataFrame, spec: SyncSpec | AgentSpec) -> tuple[DataFrame, Record, Column | None]:
    """Rows as they will be sent, the record bound to them, and the key of a call, if it has one.

    Two versions of one record must not race in parallel tasks, so only the
    last one is kept wherever the spec tells which that is. What identifies a
    record is the destination's rule: a list destination knows ``id`` only, and a list
    of creates has nothing to collapse.
    """
    record = resolve(rows, spec.field_mappings)
    order = [c for c in (spec.incremental_field, *spec.key_columns) if c]
    ident = identity(record, spec.destination_type)
    if order and ident is not None:
        rows = collapse(rows.withColumn("_id", ident), "_id", *order).drop("_id")
    key = None
    if spec.key_columns:
        # The version is part of the key: a changed row is sent, a repeated one is not.
        key = idempotency_key(f"{spec.name}/{spec.entity}", [F.col(f"`{c}`") for c in order])
    return rows, resolve(rows, spec.field_mappings), key


def _state(watermarks: WatermarkLog | None, owner: str, spec) -> object | None:
    stored = watermarks.latest(owner) if watermarks is not None else None
    return stored if stored is not None else spec.last_run


def _advance(watermarks: WatermarkLog | None, owner: str, spec, highest: object | None, ok: bool, finished: datetime) -> None:
    if watermarks is None or not spec.incremental_field:
        return
    if spec.watermark_mode == "run_clock":
        watermarks.commit(owner, finished, finished)
    elif ok and highest is not None:
        watermarks.commit(owner, highest, finished)


def _following(df: DataFrame, spec: SyncSpec, finished: datetime) -> datetime:
    schedule = df.sparkSession.range(1).select(
        F.lit(spec.interval_value).alias("interval_value"),
        F.lit(spec.interval_unit).alias("interval_unit"),
        F.lit(spec.run_at_time).cast("string").alias("run_at_time"),
        moment((spec.next_run or finished).isoformat(sep=" ")).alias("anchor"),
        moment(finished.isoformat(sep=" ")).alias("finished"),
    )
    return schedule.select(skip_forward(F.col("anchor"), F.col("finished"))).first()[0]


def run_sync(
    source: DataFrame,
    spec: SyncSpec,
    sink,
    *,
    log: RunLog | None = None,
    watermarks: WatermarkLog | None = None,
    trigger: str = "manual",
    clock: Callable[[], datetime] = _now,
    run_id: str | None = None,
) -> dict:
    """Read, convert, write and account. A failure is recorded, not raised."""
    started, run_id, owner = clock(), run_id or uuid.uuid4().hex, f"sync/{spec.sync_id}"
    read, delivered, error, highest, rows, result = 0, 0, None, None, None, Delivered()
    try:
        rows, highest = window(source, spec.incremental_field, _state(watermarks, owner, spec))
        if collapses(rows, spec):
            # Collapsing reads its input twice; both reads must see the same rows, and the source is read once.
            rows = stage(used_columns(rows, spec), "delta")
            read = rows.count()
            ready, record, key = prepare(rows, spec)
            result = sink.deliver(ready, record, spec.entity, key, run_id)
        else:
            counted = Observation()
            ready, record, key = prepare(rows.observe(counted, F.count(F.lit(1)).alias("n")), spec)
            result = sink.deliver(ready, record, spec.entity, key, run_id)
            read = counted.get["n"]
        delivered = result.written
        if result.failed:
            error = result.error or "unknown error"
    except DeliveryError as failure:
        error = str(failure)
    except Exception as failure:  # noqa: BLE001 - the run is recorded as failed
        error = f"Unexpected error: {failure}"
    if error is not None and not read and rows is not None:
        read = _count_after_failure(rows)
    finished = clock()
    _advance(watermarks, owner, spec, highest, error is None, finished)
    row = {
        "run_id": run_id,
        "sync_id": spec.sync_id,
        "status": "success" if error is None else "failed",
        "trigger": trigger,
        "started_at": started,
        "finished_at": finished,
        "records_read": read,
        # A failed run counts as nothing written; what had gone out is kept beside it.
        "records_written": delivered if error is None else 0,
        "records_delivered": delivered,
        # Sent in a list whose answer does not name them; left out because an earlier run got them through.
        "records_unconfirmed": result.unconfirmed,
        "records_skipped": result.skipped,
        "error_message": error,
        "next_run": _following(source, spec, finished),
    }
    if log is not None:
        log.append(row)
    return row


def _count_after_failure(rows: DataFrame) -> int:
    try:
        return rows.count()
    except Exception:  # noqa: BLE001 - the read itself is what failed
        return 0


def run_agent(
    source: DataFrame,
    spec: AgentSpec,
    score: Callable[[DataFrame], DataFrame],
    sink,
    *,
    row_key: str,
    log: RunLog | None = None,
    watermarks: WatermarkLog | None = None,
    clock: Callable[[], datetime] = _now,
    run_id: str | None = None,
) -> dict:
    """Read, score, keep what reaches the threshold, convert, write and account.

    ``score`` adds ``score`` and ``reason`` (see ``operators.selection``); it sees
    the raw rows. Scores are written to the shared folder before they are used:
    the summary and the write must see the same ones, and a scorer that calls a
    model must not be asked again when an executor is lost.
    """
    if spec.status == "draft" or spec.selection_rule is None:
        raise ValueError("an agent needs a plan before it can run")
    started, run_id, owner = clock(), run_id or uuid.uuid4().hex, f"agent/{spec.agent_id}"
    considered = selected = delivered = 0
    summary, error, highest, rows, result = None, None, None, None, Delivered()
    try:
        rows, highest = window(source, spec.incremental_field, _state(watermarks, owner, spec))
        scored = stage(used_columns(score(rows), spec, row_key, "score", "reason"), "scores")
        facts = selection_summary(scored, spec.threshold, row_key).first()
        considered, selected = facts["rows_considered"], facts["rows_selected"]
        summary = facts["summary"] if considered else None
        if selected:
            ready, record, key = prepare(select_rows(scored, spec.threshold).drop("score", "reason"), spec)
            result = sink.deliver(ready, record, spec.entity, key, run_id)
            delivered = result.written
            if result.failed:
                error = result.error or "unknown error"
    except DeliveryError as failure:
        error = str(failure)
    except Exception as failure:  # noqa: BLE001 - the run is recorded as failed
        error = f"Unexpected error: {failure}"
    if error is not None and not considered and rows is not None:
        considered = _count_after_failure(rows)
    finished = clock()
    _advance(watermarks, owner, spec, highest, error is None, finished)
    row = {
        "run_id": run_id,
        "agent_id": spec.agent_id,
        "status": "success" if error is None else "failed",
        "started_at": started,
        "finished_at": finished,
        "rows_considered": considered,
        "rows_selected": selected,
        "rows_written": delivered if error is None else 0,
        "rows_delivered": delivered,
        # Sent in a list whose answer does not name them; left out because an earlier run got them through.
        "rows_unconfirmed": result.unconfirmed,
        "rows_skipped": result.skipped,
        "selection_summary": summary,
        "error_message": error,
    }
    if log is not None:
        log.append(row)
    return row
