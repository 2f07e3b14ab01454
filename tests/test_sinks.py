from __future__ import annotations

import http.client
import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rowferry.operators.mapping import record_of
from rowferry.operators.upsert import idempotency_key, record_calls
from rowferry.sinks import CrmSink, FileSink, create_sink, register_crm
from rowferry.operators.replies import classify_responses
from rowferry.sinks import delivery
from rowferry.sinks.delivery import Destination, DeliveryError, Verdict, judge, send_all


def recorder(folder, answer=None):
    """A transport that keeps each request as a file, for tasks run in other processes."""

    def transport(method, url, body, headers, timeout):
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
            json.dump({"method": method, "url": url, "body": json.loads(body), "headers": headers, "timeout": timeout}, out)
        if answer is not None:
            return answer(method, url, json.loads(body))
        if "/rest/" in url:
            return 200, '{"result":1}'
        entity = url.rsplit("/", 1)[1]
        return 200, json.dumps({"_embedded": {entity: [{"id": i} for i in json.loads(body)]}})

    return transport


def requests(folder):
    return [json.load(open(os.path.join(folder, f))) for f in sorted(os.listdir(folder))]


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "requests"
    path.mkdir()
    return str(path)


def sink(tmp_path, folder, type="bitrix24", answer=None, **more):
    return CrmSink(type, "https://crm.example/", "tok", str(tmp_path / "results"), transport=recorder(folder, answer), **more)


def test_single_records(spark, tmp_path, folder):
    df = spark.createDataFrame([(7, "a"), (None, "b")], "ID int, TITLE string")
    result = sink(tmp_path, folder, timeout=5).deliver(df, record_of(df), "lead", None, "r1")
    assert (result.written, result.failed, result.error) == (2, 0, None)
    sent = sorted(requests(folder), key=lambda r: r["url"])
    assert [r["url"] for r in sent] == ["https://crm.example/rest/tok/crm.lead.add", "https://crm.example/rest/tok/crm.lead.update"]
    assert sent[1]["body"] == {"id": 7, "fields": {"TITLE": "a"}} and sent[0]["method"] == "POST" and sent[0]["timeout"] == 5


def test_not_found_is_skipped(spark, tmp_path, folder):
    def answer(method, url, body):
        return (200, '{"error":"NOT_FOUND"}') if body["fields"]["TITLE"] == "a" else (200, '{"result":1}')

    df = spark.createDataFrame([("a",), ("b",)], "TITLE string")
    result = sink(tmp_path, folder, answer=answer).deliver(df, record_of(df), "lead", None, "r1")
    assert (result.written, result.not_found, result.failed) == (1, 1, 0)


def test_first_failure_stops_the_task(spark, tmp_path, folder):
    def answer(method, url, body):
        return (500, "down") if body["fields"]["N"] >= 3 else (200, '{"result":1}')

    df = spark.range(10).select(F.col("id").alias("N")).coalesce(1)
    result = sink(tmp_path, folder, answer=answer).deliver(df, record_of(df), "lead", None, "r1")
    assert (result.written, result.failed, result.error) == (3, 1, "HTTP 500: down") and len(requests(folder)) == 4


def test_lists(spark, tmp_path, folder):
    crm = sink(tmp_path, folder, "amocrm", batch_size=4)
    updates = spark.range(10).withColumn("name", F.lit("x")).coalesce(1)
    assert crm.deliver(updates, record_of(updates), "leads", None, "r1").written == 10
    sent = requests(folder)
    assert {r["method"] for r in sent} == {"PATCH"} and sorted(len(r["body"]) for r in sent) == [2, 4, 4]
    assert sent[0]["url"] == "https://crm.example/api/v4/leads" and sent[0]["headers"]["Authorization"] == "Bearer tok"
    creates = spark.createDataFrame([("a",)], "name string")
    assert crm.deliver(creates, record_of(creates), "leads", None, "r2").written == 1
    assert {r["method"] for r in requests(folder)} == {"PATCH", "POST"}


def test_written_is_what_is_echoed(spark, tmp_path, folder):
    crm = sink(tmp_path, folder, "amocrm", answer=lambda m, u, b: (200, '{"_embedded":{"leads":[{"id":1}]}}'))
    df = spark.range(3).coalesce(1)
    result = crm.deliver(df, record_of(df), "leads", None, "r1")
    assert (result.written, result.unconfirmed, result.failed) == (1, 2, 0)


@pytest.mark.parametrize("told", ["request", "nothing"])
def test_creates_that_are_not_confirmed_go_out_again(spark, tmp_path, folder, told):
    # The first answer lists one of three records; with its place it can be told which.
    def first(method, url, body):
        item = {"id": 70, "request_id": "1"} if told == "request" else {"id": 70}
        return 200, json.dumps({"_embedded": {"leads": [item]}})

    df = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "name string, k int").coalesce(1)
    key = idempotency_key("s", [F.col("k")])
    one = sink(tmp_path, folder, "amocrm", answer=first).deliver(df, record_of(df), "leads", key, "r1")
    assert (one.written, one.unconfirmed, one.skipped) == (1, 2, 0)
    two = sink(tmp_path, folder, "amocrm").deliver(df, record_of(df), "leads", key, "r2")
    assert (two.written, two.unconfirmed, two.skipped) == ((2, 0, 1) if told == "request" else (3, 0, 0))
    three = sink(tmp_path, folder, "amocrm").deliver(df, record_of(df), "leads", key, "r3")
    assert (three.written, three.skipped) == (0, 3)


@pytest.mark.parametrize("body", ["[]", "7", "{}", '{"_embedded":{}}', '{"_embedded":{"leads":{}}}', '{"_embedded":[]}'])
def test_an_answer_without_the_list_is_a_failure(spark, tmp_path, folder, body):
    df = spark.createDataFrame([("a", 1)], "name string, k int")
    key = idempotency_key("s", [F.col("k")])
    assert sink(tmp_path, folder, "amocrm", answer=lambda *a: (200, body)).deliver(df, record_of(df), "leads", key, "r1").failed == 1
    assert sink(tmp_path, folder, "amocrm").deliver(df, record_of(df), "leads", key, "r2").written == 1


def test_only_a_missing_log_means_nothing_was_sent(spark, tmp_path, folder):
    results = tmp_path / "results"
    results.mkdir()
    (results / "x.parquet").write_text("no parquet")
    df = spark.createDataFrame([("a", 1)], "TITLE string, k int")
    with pytest.raises(Exception):
        sink(tmp_path, folder).deliver(df, record_of(df), "lead", idempotency_key("s", [F.col("k")]), "r1")
    assert requests(folder) == []


def test_transport_takes_no_redirects_and_no_cut_off_answers(monkeypatch):
    assert delivery._NoRedirects().redirect_request(None, None, 302, "", {}, "http://elsewhere/") is None

    class Broken:
        def open(self, *args, **more):
            raise http.client.IncompleteRead(b"")

    monkeypatch.setattr(delivery.urllib.request, "build_opener", lambda *a: Broken())
    status, text = delivery.http_transport("POST", "http://crm.example/", "{}", {}, 1)
    assert status is None and text
    assert judge(Destination("bitrix24", "lead", "u", "t"), 302, '{"result":1}').outcome == "failed"


def test_judge_and_the_table_form_agree(spark):
    answers = [
        (None, "no route"), (404, ""), (401, "x"), (403, ""), (500, "down"), (302, "{}"), (200, "not json"), (200, '{"result":1}'), (200, "[]"),
        (200, '{"error":"NOT_FOUND"}'), (200, '{"error":"ERROR_CORE","error_description":"why"}'), (200, '{"error":"X"}'), (200, "null"),
    ]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(answers)], "i int, status int, body string")
    table = {r["i"]: (r["outcome"], r["reason"]) for r in classify_responses(df).collect()}
    for i, (status, body) in enumerate(answers):
        found = judge(Destination("bitrix24", "lead", "u", "t"), status, body)
        assert found.outcome == table[i][0], answers[i]
        if status is not None:
            assert found.error == table[i][1], answers[i]


def test_unknown_entity_and_type(spark, tmp_path, folder):
    df = spark.range(1)
    with pytest.raises(DeliveryError):
        sink(tmp_path, folder).deliver(df, record_of(df), "invoice", None, "r1")
    with pytest.raises(DeliveryError):
        sink(tmp_path, folder, "hubspot").deliver(df, record_of(df), "lead", None, "r1")
    assert requests(folder) == []


def test_registry():
    assert create_sink("amocrm", url="https://x", token="t", results_path="/r", timeout=3).timeout == 3
    with pytest.raises(DeliveryError, match="amocrm, bitrix24"):
        create_sink("hubspot", url="https://x", token="t", results_path="/r")


def test_creates_are_not_sent_twice_but_updates_are(spark, tmp_path, folder):
    crm = sink(tmp_path, folder)
    df = spark.createDataFrame([(None, "a", 1), (7, "b", 2)], "ID int, TITLE string, k int")
    key = idempotency_key("s", [F.col("k")])
    assert crm.deliver(df, record_of(df), "lead", key, "r1").written == 2
    assert crm.deliver(df, record_of(df), "lead", key, "r1").written == 1
    assert sum(r["url"].endswith(".add") for r in requests(folder)) == 1
    # The same row with an id by now: an update must go out although its key was created before.
    later = spark.createDataFrame([(9, "a", 1)], "ID int, TITLE string, k int")
    assert crm.deliver(later, record_of(later), "lead", key, "r2").written == 1


def test_creates_in_lists_are_not_sent_twice(spark, tmp_path, folder):
    crm = sink(tmp_path, folder, "amocrm", batch_size=2)
    df = spark.createDataFrame([(f"n{i}", i) for i in range(5)], "name string, k int").coalesce(1)
    key = idempotency_key("s", [F.col("k")])
    assert crm.deliver(df, record_of(df), "leads", key, "r1").written == 5
    more = df.unionAll(spark.createDataFrame([("n9", 9)], df.schema))
    assert crm.deliver(more, record_of(more), "leads", key, "r2").written == 1
    assert [len(r["body"]) for r in requests(folder)].count(1) == 2


def test_parallelism_is_bounded(spark, tmp_path, folder):
    df = spark.range(0, 40, 1, 8).select(F.col("id").alias("N"))
    assert sink(tmp_path, folder, parallelism=2).deliver(df, record_of(df), "lead", None, "r1").written == 40


def test_not_a_number_is_refused(spark, tmp_path, folder):
    df = spark.createDataFrame([(float("nan"),)], "AMOUNT double")
    assert sink(tmp_path, folder).deliver(df, record_of(df), "deal", None, "r1").failed == 1
    assert sink(tmp_path, folder, "amocrm").deliver(df, record_of(df), "leads", None, "r1").failed == 1
    assert requests(folder) == []


def test_file_sink_overwrites_its_run(spark, tmp_path):
    files = FileSink(str(tmp_path / "out"))
    df = spark.createDataFrame([("a",), ("b",)], "TITLE string")
    for _ in range(2):
        assert files.deliver(df, record_of(df), "lead", None, "7").written == 2
    assert spark.read.parquet(files.path).count() == 2


def test_data_source(spark, tmp_path, folder):
    register_crm(spark, recorder(folder), name="crm_ok")
    df = spark.createDataFrame([(7, "a"), (None, "b")], "ID int, TITLE string")
    options = {"type": "bitrix24", "entity": "lead", "url": "https://crm.example", "token": "tok"}
    calls = record_calls(df, record_of(df), "lead")
    calls.write.format("crm_ok").options(**options).mode("append").save()
    assert len(requests(folder)) == 2
    register_crm(spark, recorder(folder, lambda m, u, b: (401, "")), name="crm_denied")
    with pytest.raises(Exception, match="credentials rejected"):
        calls.write.format("crm_denied").options(**options).mode("append").save()


def test_judge_of_a_list():
    destination = Destination("amocrm", "leads", "https://crm.example", "t")
    assert judge(destination, 200, '{"_embedded":{"leads":[1,2]}}', "[{},{}]") == Verdict("written", 2, None, (0, 1))
    assert judge(destination, 404, "").outcome == "failed"
    partial = judge(destination, 200, '{"_embedded":{"leads":[{"id":8}]}}', '[{"id":7},{"id":8}]')
    assert partial == Verdict("partial", 1, "1 of 2 records confirmed", (1,))


def test_unsent_after_failure_is_told_apart():
    destination = Destination("bitrix24", "lead", "https://crm.example", "t")
    down = lambda *a: (None, "no route")
    results = list(send_all(destination, down, [("k", "create", "crm.lead.add", "{}", False)] * 2))
    assert [r[2] for r in results] == ["failed", "not_sent"] and "no route" in results[0][4]
    assert urllib.parse.urlparse(destination.request("create", "crm.lead.add")[1]).path == "/rest/t/crm.lead.add"
