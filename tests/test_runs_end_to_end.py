from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowferry.operators.selection import score_batches, score_weighted
from rowferry.plans.activation import run_agent, run_sync, window
from rowferry.plans.log import AGENT_RUN_SCHEMA, SYNC_RUN_SCHEMA, RunLog
from rowferry.sinks import FileSink
from rowferry.sinks.delivery import Delivered, DeliveryError
from rowferry.sources.incremental import WatermarkLog
from rowferry.spec import AgentSpec, FieldMap, SyncSpec
from rowferry.streaming import deduplicate, stream_sync

D = datetime
NOW = D(2026, 1, 10, 12)


def clock():
    return NOW


class Broken:
    def __init__(self, error=None, result=None):
        self.error, self.result, self.calls = error, result, 0

    def deliver(self, df, record, entity, key, run_id):
        self.calls += 1
        if self.error:
            raise self.error
        return self.result


def spec(**more):
    base = dict(
        sync_id=1,
        name="s",
        field_mappings=(FieldMap("id", "ID"), FieldMap("email", "EMAIL", "lowercase")),
        destination_type="bitrix24",
        entity="contact",
        next_run=D(2026, 1, 10, 11, 58),
    )
    return SyncSpec(**(base | more))


@pytest.fixture()
def people(spark):
    rows = [(1, "A@x.com", D(2026, 1, 1)), (2, "B@x.com", D(2026, 1, 5)), (3, "C@x.com", None)]
    return spark.createDataFrame(rows, "id int, email string, at timestamp_ntz")


def payloads(spark, sink, run="*"):
    return sorted(r.payload for r in spark.read.parquet(f"{sink.path}/run={run}").collect())


def test_full_run(spark, tmp_path, people):
    sink, log = FileSink(str(tmp_path / "out")), RunLog(spark, str(tmp_path / "log"), SYNC_RUN_SCHEMA)
    row = run_sync(people, spec(), sink, log=log, clock=clock, run_id="r")
    assert (row["status"], row["records_read"], row["records_written"], row["error_message"]) == ("success", 3, 3, None)
    assert row["next_run"] == D(2026, 1, 10, 12, 58)
    assert payloads(spark, sink)[0] == '{"id":1,"fields":{"EMAIL":[{"VALUE":"a@x.com","VALUE_TYPE":"WORK"}]}}'
    stored = log.read().first()
    assert (stored.status, stored.records_written, stored.started_at, stored.trigger) == ("success", 3, NOW, "manual")


def test_incremental_runs(spark, tmp_path, people):
    sink, marks = FileSink(str(tmp_path / "out")), WatermarkLog(spark, str(tmp_path / "marks"))
    s = spec(incremental_field="at", key_columns=("id",))
    first = run_sync(people, s, sink, watermarks=marks, clock=clock)
    assert first["records_read"] == first["records_written"] == 3  # a row without a value comes with the full read
    assert marks.latest("sync/1") == "2026-01-05 00:00:00"
    again = run_sync(people, s, sink, watermarks=marks, clock=clock)
    assert (again["status"], again["records_read"], again["records_written"]) == ("success", 0, 0)
    more = people.unionAll(spark.createDataFrame([(4, "D@x.com", D(2026, 1, 6))], people.schema))
    third = run_sync(more, s, sink, watermarks=marks, clock=clock)
    assert (third["records_read"], marks.latest("sync/1")) == (1, "2026-01-06 00:00:00")


def test_last_version_of_a_record(spark, tmp_path):
    rows = [(1, "old@x", D(2026, 1, 1)), (1, "new@x", D(2026, 1, 2)), (None, "c@x", D(2026, 1, 1)), (None, "c@x", D(2026, 1, 1))]
    df = spark.createDataFrame(rows, "id int, email string, at timestamp_ntz")
    sink = FileSink(str(tmp_path / "out"))
    row = run_sync(df, spec(incremental_field="at"), sink, clock=clock)
    assert (row["records_read"], row["records_written"]) == (4, 3)
    found = payloads(spark, sink)
    assert sum("new@x" in p for p in found) == 1 and sum("c@x" in p for p in found) == 2 and "old@x" not in str(found)


@pytest.mark.parametrize(
    "sink, message",
    [
        (Broken(DeliveryError("CRM says no")), "CRM says no"),
        (Broken(RuntimeError("odd")), "Unexpected error: odd"),
        (Broken(result=Delivered(written=2, failed=1, error="HTTP 500: x")), "HTTP 500: x"),
    ],
)
def test_failure_is_recorded(spark, tmp_path, people, sink, message):
    marks = WatermarkLog(spark, str(tmp_path / "marks"))
    s = spec(incremental_field="at")
    if sink.result is not None:  # a sink that reads, then fails
        real = sink.deliver
        sink.deliver = lambda df, *a: (df.write.format("noop").mode("overwrite").save(), real(df, *a))[1]
    row = run_sync(people, s, sink, watermarks=marks, clock=clock)
    assert (row["status"], row["error_message"]) == ("failed", message)
    assert (row["records_read"], row["records_written"]) == (3, 0)
    assert row["records_delivered"] == (2 if sink.result else 0)
    assert marks.latest("sync/1") is None  # the rows come again
    assert row["next_run"] == D(2026, 1, 10, 12, 58)  # on schedule all the same


def test_run_clock_mode_advances_after_a_failure(spark, tmp_path, people):
    marks = WatermarkLog(spark, str(tmp_path / "marks"))
    run_sync(people, spec(incremental_field="at", watermark_mode="run_clock"), Broken(DeliveryError("x")), watermarks=marks, clock=clock)
    assert marks.latest("sync/1") == NOW.isoformat(sep=" ")


def test_missing_source_column_is_a_recorded_failure(spark, people):
    row = run_sync(people, spec(incremental_field="nope"), Broken(), clock=clock)
    assert row["status"] == "failed" and row["records_read"] == 0


def test_after_an_outage_the_next_slot_lies_ahead(spark, people):
    row = run_sync(people, spec(next_run=NOW - timedelta(days=3, minutes=1)), Broken(DeliveryError("x")), clock=clock)
    assert row["next_run"] == NOW + timedelta(minutes=59)


def agent(**more):
    base = dict(
        agent_id=1, name="a", goal="g", actions="call", field_mappings=(FieldMap("id", "id"),), destination_type="amocrm",
        entity="contacts", threshold=0.5, status="ready", selection_rule="r",
    )
    return AgentSpec(**(base | more))


def fixed(spark, *values):
    table = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "id int, score double")
    return lambda df: df.join(table, "id").withColumn("reason", F.lit("because"))


def test_agent(spark, tmp_path, people):
    sink, log = FileSink(str(tmp_path / "out"), "amocrm"), RunLog(spark, str(tmp_path / "log"), AGENT_RUN_SCHEMA)
    row = run_agent(people, agent(), fixed(spark, 0.9, 0.2, 0.5), sink, row_key="id", log=log, clock=clock)
    assert (row["status"], row["rows_considered"], row["rows_selected"], row["rows_written"]) == ("success", 3, 2, 2)
    assert row["selection_summary"].startswith("Selected 2 of 3 rows considered (threshold 0.50).\n- row 1 (score 0.90): because")
    assert payloads(spark, sink) == ['{"id":1}', '{"id":3}'] and log.read().count() == 1


def test_the_agents_row_has_all_that_happened(spark, tmp_path, people):
    class Partial:
        type = "amocrm"

        def deliver(self, *args):
            return Delivered(written=1, unconfirmed=2, skipped=3)

    log = RunLog(spark, str(tmp_path / "log"), AGENT_RUN_SCHEMA)
    run_agent(people, agent(), fixed(spark, 0.9, 0.2, 0.5), Partial(), row_key="id", log=log, clock=clock)
    (row,) = log.read().collect()
    assert (row["rows_written"], row["rows_delivered"], row["rows_unconfirmed"], row["rows_skipped"]) == (1, 1, 2, 3)


def test_agent_without_selected_rows_leaves_the_destination_alone(spark, people):
    sink = Broken(DeliveryError("must not be called"))
    row = run_agent(people, agent(threshold=0.9), fixed(spark, 0.1, 0.1, 0.1), sink, row_key="id", clock=clock)
    assert (row["status"], row["rows_selected"], sink.calls) == ("success", 0, 0)


def test_agent_without_rows(spark, people):
    row = run_agent(people.where("false"), agent(), lambda df: score_weighted(df, []), Broken(DeliveryError("x")), row_key="id", clock=clock)
    assert (row["status"], row["rows_considered"], row["selection_summary"]) == ("success", 0, None)


def test_agent_with_a_failing_scorer(spark, people):
    def broken(batch):
        raise RuntimeError("model is down")

    row = run_agent(people, agent(), lambda df: score_batches(df, broken), Broken(), row_key="id", clock=clock)
    assert row["status"] == "failed" and "model is down" in row["error_message"] and row["rows_considered"] == 3


@pytest.mark.parametrize("more", [{"status": "draft"}, {"selection_rule": None}])
def test_agent_without_a_plan(people, more):
    with pytest.raises(ValueError):
        run_agent(people, agent(**more), lambda df: df, Broken(), row_key="id")


def test_scores_are_asked_for_once(spark, tmp_path, people):
    asked = str(tmp_path / "asked")

    def scorer(batch):
        with open(asked, "a") as out:
            out.write("x" * len(batch))
        return [(i, 1.0, "") for i in range(len(batch))]

    run_agent(people, agent(), lambda df: score_batches(df, scorer), FileSink(str(tmp_path / "o"), "amocrm"), row_key="id", clock=clock)
    assert len(open(asked).read()) == 3


def test_stream(spark, tmp_path, people):
    source, sink = str(tmp_path / "in"), FileSink(str(tmp_path / "out"))
    log = RunLog(spark, str(tmp_path / "log"), SYNC_RUN_SCHEMA)
    s = spec(incremental_field="at", key_columns=("id",))

    def go():
        stream = spark.readStream.schema(people.schema).parquet(source)
        stream_sync(stream, s, sink, str(tmp_path / "cp"), log=log, clock=clock).awaitTermination()

    people.write.parquet(source)
    go()
    assert len(payloads(spark, sink)) == 3
    go()  # nothing new
    assert len(payloads(spark, sink)) == 3 and log.read().count() == 1
    # A late row is older than all that was read, and is not lost.
    spark.createDataFrame([(9, "late@x", D(2020, 1, 1))], people.schema).write.mode("append").parquet(source)
    go()
    assert len(payloads(spark, sink)) == 4 and sorted(r.records_read for r in log.read().collect()) == [1, 3]


def test_failed_batch_comes_again(spark, tmp_path, people):
    source = str(tmp_path / "in")
    people.write.parquet(source)

    def go(sink):
        stream = spark.readStream.schema(people.schema).parquet(source)
        stream_sync(stream, spec(), sink, str(tmp_path / "cp"), clock=clock).awaitTermination()

    with pytest.raises(Exception, match="CRM says no"):
        go(Broken(DeliveryError("CRM says no")))
    sink = FileSink(str(tmp_path / "out"))
    go(sink)
    assert len(payloads(spark, sink)) == 3


def test_stream_without_repeats(spark, tmp_path, people):
    source, sink = str(tmp_path / "in"), FileSink(str(tmp_path / "out"))
    timed = people.where("at is not null")
    timed.unionAll(timed).write.parquet(source)
    stream = deduplicate(spark.readStream.schema(people.schema).parquet(source), ["id"], "at")
    stream_sync(stream, spec(), sink, str(tmp_path / "cp"), clock=clock).awaitTermination()
    assert len(payloads(spark, sink)) == 2


def test_records_are_identified_by_the_destinations_rule(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, None, "c")], "k int, ext int, name string")
    base = dict(sync_id=1, name="s", destination_type="amocrm", entity="leads", key_columns=("k",))
    creates = SyncSpec(**base, field_mappings=(FieldMap("ext", "ID"), FieldMap("name", "name")))
    sink = FileSink(str(tmp_path / "creates"), type="amocrm")
    assert run_sync(rows, creates, sink, run_id="1")["records_written"] == 3
    updates = SyncSpec(**base, field_mappings=(FieldMap("ext", "id"), FieldMap("name", "name")))
    sink = FileSink(str(tmp_path / "updates"), type="amocrm")
    assert run_sync(rows, updates, sink, run_id="1")["records_written"] == 2
    kept = {r["payload"] for r in spark.read.parquet(sink.path).collect()}
    assert '{"id":7,"name":"b"}' in kept


def test_long_errors_are_kept_whole(spark):
    class Failing:
        def deliver(self, *args):
            raise DeliveryError("x" * 5000)

    spec = SyncSpec(sync_id=1, name="s", destination_type="bitrix24", entity="lead", field_mappings=(FieldMap("id", "TITLE"),))
    row = run_sync(spark.range(1), spec, Failing(), run_id="1")
    assert row["status"] == "failed" and len(row["error_message"]) == 5000


def test_nothing_new_reads_nothing(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    found, highest = window(rows, "v", 5)
    assert highest is None and found.count() == 0
    # A full read still has the rows without a value.
    assert window(rows.where("v IS NULL"), "v", None)[0].count() == 1


def test_a_run_reads_its_source_once(spark, tmp_path):
    """One read for the upper end of the window, one for the run; only columns in use are staged."""
    reads = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, i % 5, f"n{i}", "unused") for i in range(50)], "k int, ext int, name string, other string")
    counted = rows.coalesce(1).mapInArrow(touch, rows.schema)
    sync = SyncSpec(
        sync_id=1, name="s", destination_type="bitrix24", entity="lead", incremental_field="k", key_columns=("k",),
        field_mappings=(FieldMap("ext", "ID"), FieldMap("name", "TITLE")),
    )
    row = run_sync(counted, sync, FileSink(str(tmp_path / "out")), run_id="1")
    assert row["status"] == "success" and (row["records_read"], row["records_written"]) == (50, 14)
    assert reads.value == 100
