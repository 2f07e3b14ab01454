"""Polling replaced by Structured Streaming: each micro-batch is a run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.mapping import resolve
from ..plans.activation import _now, identity, run_sync
from ..plans.log import RunLog
from ..session import entries, remove_folder, stage
from ..sinks.delivery import DeliveryError
from ..sources.incremental import is_missing_path
from ..spec import SyncSpec


def deduplicate(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Repeated rows of one key within ``delay`` once; state older than that is dropped."""
    # Watermarks need a TIMESTAMP; a column without a zone is read as UTC for it.
    timed = stream.withColumn("_event_time", F.col(event_time).cast("timestamp"))
    return timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(keys).drop("_event_time")


class VersionLog:
    """The last version sent of each record, as a parquet table of (id, version).

    A batch adds the versions it sent, in a folder of its own, so a repeated batch adds nothing;
    the greatest version of an id counts. ``compact`` leaves one row per id; call it while the
    stream is down.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def latest(self) -> DataFrame | None:
        try:
            rows = self._spark.read.parquet(self._path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None
        return rows.groupBy("id").agg(F.max("version").alias("version"))

    def commit(self, versions: DataFrame, batch: int) -> None:
        versions.write.mode("overwrite").parquet(f"{self._path}/batch={batch}")

    def compact(self) -> None:
        """One row per id. The new folder is complete before the old ones go: what a crash leaves
        beside it says nothing else, since the greatest version counts."""
        latest, before = self.latest(), entries(self._spark, self._path)
        if latest is None:
            return
        numbers = [int(name[len("batch=") : -1]) for name in before if name.startswith("batch=")]
        latest.write.parquet(f"{self._path}/batch={min([0, *numbers]) - 1}")
        for name in before:
            remove_folder(self._spark, f"{self._path}/{name}")


def _not_older(batch: DataFrame, spec: SyncSpec, versions: VersionLog) -> tuple[DataFrame, DataFrame | None]:
    """The rows that are no older than what was sent, and the versions this batch sends."""
    ident = identity(resolve(batch, spec.field_mappings), spec.destination_type)
    if ident is None or not spec.incremental_field:
        return batch, None
    named = batch.withColumn("_id", ident).withColumn("_version", F.col(f"`{spec.incremental_field}`"))
    known = versions.latest()
    if known is not None:
        joined = named.join(known.select(F.col("id").alias("_id"), F.col("version").alias("_sent")), "_id", "left")
        # Rows without a version can't be told to be newer than what was sent.
        named = joined.where(F.col("_sent").isNull() | F.coalesce(F.col("_version") >= F.col("_sent"), F.lit(False))).drop("_sent")
    # Read twice, by the write and by the commit: both must see the same rows.
    named = stage(named, "batch")
    sent = named.where("_id IS NOT NULL AND _version IS NOT NULL").groupBy(F.col("_id").alias("id"))
    return named.drop("_id", "_version"), sent.agg(F.max("_version").alias("version"))


def stream_sync(
    stream: DataFrame,
    spec: SyncSpec,
    sink,
    checkpoint: str,
    *,
    log: RunLog | None = None,
    clock: Callable[[], datetime] = _now,
    available_now: bool = True,
    every: str = "30 seconds",
    versions: VersionLog | None = None,
) -> StreamingQuery:
    """Feed what is new in the stream to the sink.

    The checkpoint holds the position, so neither a watermark column nor late
    rows matter. A micro-batch may be replayed after a crash; its run id is its
    number, so a file sink overwrites its own output and a CRM sink leaves out
    the creates its log already has. A failed batch stops the query and is
    tried again at the next start.

    With ``versions`` a late row does not overwrite a newer version (by the incremental
    field) that an earlier batch has sent; such rows are left out. Without it the
    rows of a later batch always win.
    """
    from dataclasses import replace

    def run(batch: DataFrame, number: int) -> None:
        # The order column still tells which version of a record is the last.
        order = tuple(c for c in (spec.incremental_field, *spec.key_columns) if c)
        unbounded = replace(spec, incremental_field=None, key_columns=order)
        sent = None
        if versions is not None:
            batch, sent = _not_older(batch, spec, versions)
        row = run_sync(batch, unbounded, sink, log=log, trigger="scheduled", clock=clock, run_id=f"{spec.sync_id}-{number}")
        if row["status"] == "failed":
            raise DeliveryError(row["error_message"])
        if sent is not None:
            versions.commit(sent, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
