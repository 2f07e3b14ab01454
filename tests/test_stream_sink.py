from __future__ import annotations

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowferry.operators.mapping import record_of
from rowferry.operators.upsert import idempotency_key
from rowferry.queries.delivery import _Counting
from rowferry.sinks.delivery import DeliveryError, Destination
from rowferry.sinks.stream import Journal, _CrmStreamWriter, register_crm_stream, stream_rows

NAMES = ["call_key", "op", "method", "payload", "unsendable"]


class Crm:
    """Accepts all but what it is told to refuse."""

    def __init__(self, refuse=()):
        self.refuse, self.got = set(refuse), []

    def __call__(self, method, url, body, headers, timeout):
        sent = json.loads(body)
        items = sent if isinstance(sent, list) else [sent]
        if any(i["n"] in self.refuse for i in items):
            return 500, "down"
        self.got += [i["n"] for i in items]
        return 200, json.dumps({"result": 1, "_embedded": {"leads": items}})


def writer(tmp_path, crm, type="bitrix24", batch_size=3):
    return _CrmStreamWriter(Destination(type, "lead" if type == "bitrix24" else "leads", "http://crm.example", ""), NAMES, crm, Journal(str(tmp_path)), batch_size)


def rows(numbers, op="create"):
    return [(None if n is None else f"k{n}", op, "m", json.dumps({"n": n}), False) for n in numbers]


@pytest.mark.parametrize("type,first", [("bitrix24", [0, 1, 2, 3, 4]), ("amocrm", [0, 1, 2])])
def test_a_failed_batch_goes_on_where_it_stopped(tmp_path, type, first):
    crm = Crm(refuse=[5])
    with pytest.raises(DeliveryError):
        writer(tmp_path, crm, type).write(iter(rows(range(10))))
    assert crm.got == first
    crm.refuse = set()
    writer(tmp_path, crm, type).write(iter(rows(range(10))))
    assert sorted(crm.got) == list(range(10))


def test_a_replay_after_the_commit_adds_nothing(tmp_path):
    crm = Crm()
    for batch, numbers in ((0, range(5)), (0, range(5)), (1, range(5, 9)), (1, range(5, 9)), (2, range(2))):
        out = writer(tmp_path, crm)
        out.commit([out.write(iter(rows(numbers)))], batch)
    # Batch 2 brings creates of batch 0 again, which Spark has long done with: they are creates of their own.
    assert crm.got == [*range(9), 0, 1]
    assert len(Journal(str(tmp_path))._names("batches")) == 1 and len(Journal(str(tmp_path))._names("keys")) == 2


def test_updates_and_rows_without_a_key_go_out_again(tmp_path):
    crm = Crm()
    for _ in range(2):
        writer(tmp_path, crm).write(iter(rows([1], op="update") + rows([None, 2])))
    assert sorted(crm.got, key=str) == [1, 1, 2, None, None]


def test_journal_that_was_cut_off(tmp_path):
    journal = Journal(str(tmp_path))
    name, out = journal.open(7)
    out.write(b"whole\npar")
    out.close()
    assert journal.keys(7) == {"whole"} and journal.keys(8) == set()
    (tmp_path / "batches").mkdir()
    (tmp_path / "batches" / "0").write_text('["keys/0')
    journal.commit(1)
    assert journal.keys(7) == {"whole"} and json.loads((tmp_path / "batches" / "1").read_text()) == [name]
    journal.commit(2)
    assert journal.keys(7) == set()


def test_starts_after_a_failure(spark, tmp_path):
    """Through Spark: three files, a failure amid the first batch, a second start, a third one with nothing new."""
    register_crm_stream(spark, _Counting(str(tmp_path / "received")), "crm_test_stream")
    (tmp_path / "received" / "accepted").mkdir(parents=True)
    spark.range(120).select(F.col("id").alias("KEY")).repartition(3).write.parquet(str(tmp_path / "in"))
    failures = 0
    for _ in range(3):
        stream = spark.readStream.schema("KEY bigint").parquet(str(tmp_path / "in"))
        out = stream_rows(stream, record_of(stream), "bitrix24", "lead", idempotency_key("t", [F.col("KEY")]), 3).writeStream
        out = out.format("crm_test_stream").option("journal", f"file:{tmp_path}/journal").option("checkpointLocation", f"{tmp_path}/checkpoint")
        out = out.option("type", "bitrix24").option("entity", "lead").option("url", "http://crm.example").trigger(availableNow=True)
        try:
            out.start().awaitTermination()
        except StreamingQueryException as error:
            assert "HTTP 500: down" in str(error)
            failures += 1
    accepted = [int(line) for file in (tmp_path / "received" / "accepted").iterdir() for line in file.read_text().split()]
    assert sorted(accepted) == list(range(120)) and failures == 1
