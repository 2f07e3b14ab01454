"""The sender, with a transport inside the task whose answer depends on the record only."""

from __future__ import annotations

import json
import uuid

from pyarrow.fs import FileType
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..files import file_system
from ..operators.mapping import resolve
from ..operators.selection import score_weighted
from ..operators.upsert import idempotency_key
from ..plans.activation import run_agent, run_sync
from ..session import staging_path
from ..sinks import CrmSink, FileSink, register_crm_stream, stream_rows
from ..spec import AgentSpec, FieldMap, SyncSpec
from .registry import SCHEMAS, query, table

COUNTS = "run int, written bigint, not_found bigint, failed bigint, unconfirmed bigint, skipped bigint"


def _records(method, url, body, headers, timeout):
    key = json.loads(body)["fields"]["KEY"]
    return (200, '{"error":"NOT_FOUND"}') if key % 7 == 0 else (200, '{"result":1}')


def _lists(method, url, body, headers, timeout):
    echoed = [{"id": 10 * item["key"], "request_id": str(i)} for i, item in enumerate(json.loads(body)) if item["key"] % 3]
    return 200, json.dumps({"_embedded": {"contacts": echoed}})


def _down(method, url, body, headers, timeout):
    return (500, "down") if json.loads(body)["fields"]["KEY"] % 5 == 0 else (200, '{"result":1}')


def _delivered(spark, df, maps, type_, entity, transport):
    """The counts of two runs over the same rows, one result log."""
    sink = CrmSink(type_, "http://crm.example", "t", staging_path(spark, "results"), transport=transport, parallelism=4)
    key, rows = idempotency_key("customers", [F.col("c_custkey")]), []
    for run in (1, 2):
        r = sink.deliver(df, resolve(df, maps), entity, key, f"r{run}")
        rows.append((run, r.written, r.not_found, r.failed, r.unconfirmed, r.skipped))
    return spark.createDataFrame(rows, COUNTS)


@query(
    "deliver_records",
    """
SELECT 1 AS run, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS written, count(*) FILTER (WHERE c_custkey % 7 = 0) AS not_found, CAST(0 AS BIGINT) AS failed,
       CAST(0 AS BIGINT) AS unconfirmed, CAST(0 AS BIGINT) AS skipped FROM customer
UNION ALL
SELECT 2, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey % 2 = 1), count(*) FILTER (WHERE c_custkey % 7 = 0), 0, 0, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey % 2 = 0)
FROM customer
""",
)
def deliver_records(spark, folder):
    """Odd keys are updates, even ones creates; creates that got through are not sent again."""
    df = table(spark, folder, "customer").withColumn("crm_id", F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey")))
    maps = (FieldMap("crm_id", "ID"), FieldMap("c_custkey", "KEY"), FieldMap("c_name", "NAME"))
    return _delivered(spark, df, maps, "bitrix24", "contact", _records)


@query(
    "deliver_lists_partial",
    """
SELECT 1 AS run, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS written, CAST(0 AS BIGINT) AS not_found, CAST(0 AS BIGINT) AS failed,
       count(*) FILTER (WHERE c_custkey % 3 = 0) AS unconfirmed, CAST(0 AS BIGINT) AS skipped FROM customer
UNION ALL
SELECT 2, 0, 0, 0, count(*) FILTER (WHERE c_custkey % 3 = 0), count(*) FILTER (WHERE c_custkey % 3 <> 0) FROM customer
""",
)
def deliver_lists_partial(spark, folder):
    """Lists of which the destination confirms two records of three: the others go out again."""
    maps = (FieldMap("c_custkey", "key"), FieldMap("c_name", "name"))
    return _delivered(spark, table(spark, folder, "customer"), maps, "amocrm", "contacts", _lists)


def _confirmed(method, url, body, headers, timeout):
    return 200, json.dumps({"_embedded": {"contacts": [{"id": 1}] * len(json.loads(body))}})


@query(
    "deliver_bucketed_log",
    """
WITH c AS (SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 3 <> 2) AS b, count(*) AS n FROM orders)
SELECT 1 AS run, a AS written, CAST(0 AS BIGINT) AS skipped FROM c UNION ALL SELECT 2, b - a, a FROM c UNION ALL SELECT 3, n - b, b FROM c
UNION ALL SELECT 4, 0, n FROM c
""",
)
def deliver_bucketed_log(spark, folder):
    """Four runs over a growing share of the orders, lists of creates; each run meets the keys of all runs before."""
    sink = CrmSink("amocrm", "http://crm.example", "t", staging_path(spark, "results"), transport=_confirmed, parallelism=4)
    maps, rows = (FieldMap("o_orderkey", "key"), FieldMap("o_orderpriority", "name")), []
    orders = table(spark, folder, "orders")
    part = F.col("o_orderkey") % 3
    for run, rest in enumerate((part == 0, part != 2, F.lit(True), F.lit(True)), 1):
        df = orders.where(rest)
        r = sink.deliver(df, resolve(df, maps), "contacts", idempotency_key("orders", [F.col("o_orderkey")]), f"r{run}")
        rows.append((run, r.written, r.skipped))
    return spark.createDataFrame(rows, "run int, written bigint, skipped bigint")


@query(
    "deliver_failure",
    """
SELECT 'failed' AS status, count(*) AS records_read, CAST(0 AS BIGINT) AS records_written, 'HTTP 500: down' AS error_message FROM customer
""",
)
def deliver_failure(spark, folder):
    """A run that meets a failure is recorded, and counts nothing as written."""
    spec = SyncSpec(
        sync_id=3, name="customers", destination_type="bitrix24", entity="contact",
        field_mappings=(FieldMap("c_custkey", "KEY"), FieldMap("c_name", "NAME")),
    )
    sink = CrmSink("bitrix24", "http://crm.example", "t", staging_path(spark, "results"), transport=_down, parallelism=4)
    row = run_sync(table(spark, folder, "customer"), spec, sink, run_id="r1")
    shown = (row["status"], row["records_read"], row["records_written"], row["error_message"])
    return spark.createDataFrame([shown], "status string, records_read bigint, records_written bigint, error_message string")


class _Counting:
    """A stand-in for the destination: it notes every create it accepts, and is down once, at one record amid the others."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, method, url, body, headers, timeout):
        key = json.loads(body)["fields"]["KEY"]
        system, root = file_system(self.folder)
        down = f"{root}/down"
        if key % 50 == 25 and system.get_file_info(down).type == FileType.NotFound:
            system.open_output_stream(down).close()
            return 500, "down"
        if not hasattr(self, "notes"):
            self.notes = system.open_output_stream(f"{root}/accepted/{uuid.uuid4().hex}")
        self.notes.write(f"{key}\n".encode())
        self.notes.flush()
        return 200, '{"result":1}'

    def __getstate__(self):
        return {"folder": self.folder}


@query("stream_sink_commit", "SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(1 AS BIGINT) AS times FROM customer")
def stream_sink_commit(spark, folder):
    """Customers as a stream of creates into a sink that fails once; after two starts each create has arrived once."""
    received = staging_path(spark, "received")
    system, root = file_system(received)
    system.create_dir(f"{root}/accepted", recursive=True)
    register_crm_stream(spark, _Counting(received), "crm_counting")
    maps = (FieldMap("c_custkey", "KEY"), FieldMap("c_name", "NAME"))
    checkpoint, journal = staging_path(spark, "stream-checkpoint"), staging_path(spark, "journal")
    for start in (1, 2):
        stream = spark.readStream.schema(SCHEMAS["customer"]).parquet(f"{folder}/customer*.parquet")
        key = idempotency_key("customers", [F.col("c_custkey")])
        rows = stream_rows(stream, resolve(stream, maps), "bitrix24", "contact", key, parallelism=4)
        writer = rows.writeStream.format("crm_counting").option("checkpointLocation", checkpoint).option("journal", journal)
        writer = writer.option("type", "bitrix24").option("entity", "contact").option("url", "http://crm.example")
        try:
            writer.trigger(availableNow=True).start().awaitTermination()
        except StreamingQueryException:
            if start == 2:
                raise
    return spark.read.text(f"{received}/accepted").groupBy(F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("times"))


@query(
    "agent_none_selected",
    "SELECT 'success' AS status, count(*) AS rows_considered, CAST(0 AS BIGINT) AS rows_selected, CAST(0 AS BIGINT) AS rows_written FROM customer",
)
def agent_none_selected(spark, folder):
    """Nothing reaches the threshold: a success that writes nothing."""
    spec = AgentSpec(
        agent_id=2, name="nobody", goal="offer credit", actions="call", destination_type="amocrm", entity="contacts",
        field_mappings=(FieldMap("c_custkey", "id"),), status="ready", selection_rule="", threshold=1.5,
    )
    score = lambda df: score_weighted(df, [(F.col("c_acctbal") / 10000, 1.0)])
    sink = FileSink(staging_path(spark, "nobody"), type="amocrm")
    row = run_agent(table(spark, folder, "customer"), spec, score, sink, row_key="c_custkey", run_id="r1")
    shown = (row["status"], row["rows_considered"], row["rows_selected"], row["rows_written"])
    return spark.createDataFrame([shown], "status string, rows_considered bigint, rows_selected bigint, rows_written bigint")
