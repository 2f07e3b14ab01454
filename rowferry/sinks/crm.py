"""Sending records to a CRM from the tasks that hold them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.mapping import Record
from ..operators.upsert import batch_items, batch_payloads, record_calls, written_counts
from ..spec import DESTINATION_ENTITIES
from .delivery import SKIPPED, Delivered, DeliveryError, Destination, Transport, http_transport, send_all
from .sent import SentKeys

RESULT_SCHEMA = "call_keys array<string>, op string, outcome string, items int, error string, unconfirmed int"
_RESULT_COLUMNS = ["call_keys", "op", "outcome", "items", "error", "unconfirmed"]


def require_entity(destination_type: str, entity: str) -> None:
    known = DESTINATION_ENTITIES.get(destination_type)
    if known is None:
        raise DeliveryError(f"No destination registered for type '{destination_type}'.")
    if entity not in known:
        raise DeliveryError(f"{destination_type} has no entity '{entity}'. Available: {', '.join(known)}.")


def send_calls(calls: DataFrame, destination: Destination, transport: Transport) -> DataFrame:
    """One result per call of (call_keys, op, method, payload, unsendable).

    Lazy, and sending is a side effect: write the result to a table once and
    read it from there.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for frame in frames:
                yield from frame.itertuples(index=False, name=None)

        chunk = []
        for result in send_all(destination, transport, rows()):
            chunk.append(result)
            if len(chunk) == 1000:
                yield pd.DataFrame(chunk, columns=_RESULT_COLUMNS)
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=_RESULT_COLUMNS)

    columns = calls.select("call_keys", "op", "method", "payload", "unsendable")
    return columns.mapInPandas(run, RESULT_SCHEMA)


class CrmSink:
    """Sends records and keeps one result row per call below ``results_path``.

    A retried task sends again: updates are harmless, creates are protected
    against a second run by the index of sent keys (see ``SentKeys``; ``sent_buckets`` is for a new one),
    not against a retry inside a run. Turn speculation off for such jobs.
    ``parallelism`` bounds how many tasks call the destination at once; the
    default is one call at a time, None leaves it to the cluster.

    Of a list that the destination confirms in part, only the records it names are
    logged as sent; the others go out again with a later run.
    """

    def __init__(
        self,
        type: str,
        url: str,
        token: str,
        results_path: str,
        *,
        transport: Transport = http_transport,
        timeout: float = 30.0,
        parallelism: int | None = 1,
        batch_size: int = 250,
        sent_buckets: int | None = None,
    ):
        self.type, self.url, self.token, self.timeout = type, url, token, timeout
        self.results_path, self.transport = results_path, transport
        self.parallelism, self.batch_size, self.sent_buckets = parallelism, batch_size, sent_buckets

    def deliver(self, df: DataFrame, record: Record, entity: str, key: Column | None, run_id: str) -> Delivered:
        require_entity(self.type, entity)
        spark = df.sparkSession
        destination = Destination(self.type, entity, self.url, self.token, self.timeout)
        keyed = df.withColumn("call_key", F.lit(None).cast("string") if key is None else key)
        # Without keys there is nothing to compare, and a join on nulls would put all rows into one task.
        index = None if key is None else SentKeys(spark, self.results_path, RESULT_SCHEMA, self.sent_buckets)
        marked = (lambda calls: calls) if index is None else index.mark_sent
        if self.type == "bitrix24":
            calls = marked(record_calls(keyed, record, entity, keep=("call_key",)))
            calls = self._bounded(calls).withColumn("call_keys", F.array("call_key"))
        else:
            items = marked(batch_items(keyed, record, keep=("call_key",)))
            calls = batch_payloads(self._bounded(items), self.batch_size, "call_key").withColumn("method", F.lit(None).cast("string"))
        # One folder per attempt: a repeated run adds to the log and is counted alone.
        name = f"run={run_id}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.results_path.rstrip('/')}/{name}"
        send_calls(calls, destination, self.transport).write.mode("append").parquet(folder)
        if index is not None:
            index.add([name])
        results = spark.read.schema(RESULT_SCHEMA).parquet(folder)
        counts = written_counts(results).first()
        unnamed = F.coalesce(F.sum("unconfirmed"), F.lit(0)).alias("unconfirmed")
        skipped = F.coalesce(F.sum(F.when(F.col("outcome") == SKIPPED, F.col("items"))), F.lit(0)).alias("skipped")
        rest = results.agg(F.min(F.when(F.col("outcome") == "failed", F.col("error"))).alias("error"), unnamed, skipped).first()
        return Delivered(counts["written"], counts["not_found"], counts["failed"], rest["error"], rest["unconfirmed"], rest["skipped"])

    def _bounded(self, df: DataFrame) -> DataFrame:
        # Not coalesce: that would also read and convert in so few tasks.
        return df if self.parallelism is None else df.repartition(self.parallelism)


@dataclass
class _Counts(WriterCommitMessage):
    written: int
    not_found: int
    failed: int
    error: str | None


class _CrmWriter(DataSourceWriter):
    def __init__(self, destination: Destination, names: list[str], transport: Transport):
        self.destination, self.names, self.transport = destination, names, transport

    def write(self, iterator) -> WriterCommitMessage:
        def calls():
            for row in iterator:
                value = dict(zip(self.names, row))
                yield (
                    value.get("call_keys"), value["op"], value.get("method"), value["payload"],
                    value.get("unsendable", False),
                )

        tally = {"written": 0, "not_found": 0, "failed": 0}
        first_error = None
        for _, _, outcome, items, error, _ in send_all(self.destination, self.transport, calls()):
            if outcome in ("written", "partial"):
                tally["written"] += items
            elif outcome in tally:
                tally[outcome] += 1
            if outcome == "failed":
                first_error = first_error or error
        return _Counts(error=first_error, **tally)

    def commit(self, messages) -> None:
        if any(m.failed for m in messages if m):
            raise DeliveryError(next(m.error for m in messages if m and m.error))

    def abort(self, messages) -> None:
        """Nothing to undo: what a CRM has accepted stays there."""


def register_crm(spark: SparkSession, transport: Transport = http_transport, name: str = "crm") -> None:
    """Make ``df.write.format("crm")`` available.

    Options: type, entity, url, token, timeout. The frame has op, payload and, for
    single records, method. There is no log of what was sent: a repeated write sends
    again. Use ``CrmSink`` where that matters, and for the counts.
    """

    class CrmDataSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            o = self.options
            require_entity(o["type"], o["entity"])
            destination = Destination(o["type"], o["entity"], o["url"], o.get("token", ""), float(o.get("timeout", 30)))
            return _CrmWriter(destination, schema.names, transport)

    spark.dataSource.register(CrmDataSource)
