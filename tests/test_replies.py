from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowferry.operators import replies as R
from rowferry.operators.selection import NOT_SCORED
from rowferry.sinks.delivery import Destination, judge

UNSCORED = (0.0, NOT_SCORED)


def scores(spark, reply, n=2):
    df = spark.createDataFrame([(reply, n)], "reply string, n int")
    return [(r.score, r.reason) for r in R.parse_scores(df, batch_len="n").orderBy("row_index").collect()]


def test_scores(spark):
    reply = {"scores": [{"index": 0, "score": 0.9, "reason": "fits"}, {"index": 1, "score": 0.1, "reason": "no"}]}
    assert scores(spark, json.dumps(reply)) == [(0.9, "fits"), (0.1, "no")]


@pytest.mark.parametrize(
    "item, expected",
    [
        ({"index": 0, "score": 5.0}, (1.0, "")),
        ({"index": 0, "score": -1}, (0.0, "")),
        ({"index": "0", "score": "0.5", "reason": " x "}, (0.5, "x")),
        ({"index": 0.7, "score": True}, (1.0, "")),
        ({"index": False, "score": 1}, (1.0, "")),
        ({"index": 0}, (0.0, "")),
        ({"index": 0, "score": None, "reason": "r"}, UNSCORED),
        ({"index": "0.0", "score": 1}, UNSCORED),
        ({"index": None, "score": 1}, UNSCORED),
        ({"index": [0], "score": 1}, UNSCORED),
        ({"index": 0, "score": "high"}, UNSCORED),
        ({"index": 0, "score": "5d"}, UNSCORED),
        ({"index": 0, "score": "true"}, UNSCORED),
        ({"index": "true", "score": 1}, UNSCORED),
        ({"index": 0, "score": "inf"}, (1.0, "")),
        ({"index": 0, "score": " 0.2_5 "}, (0.25, "")),
        ({"index": "0_0", "score": 2.5e-1}, (0.25, "")),
        ({"index": 1e30, "score": 1}, UNSCORED),
        ({"index": -0.5, "score": False}, (0.0, "")),
        ({"index": 0, "score": 1, "reason": "0"}, (1.0, "0")),
        ({"index": 0, "score": 1, "reason": False}, (1.0, "")),
        ({"index": 0, "score": 1, "reason": 1.5}, (1.0, "1.5")),
        ({"index": 0, "score": 1, "reason": [1]}, (1.0, "[1]")),
        ({"index": 2, "score": 1}, UNSCORED),
        ({"index": -1, "score": 1}, UNSCORED),
        ({"score": 1}, UNSCORED),
        ({"index": 0, "score": 1, "reason": 0}, (1.0, "")),
        ({"index": 0, "score": 1, "reason": 12}, (1.0, "12")),
        ({"index": 0, "score": 1, "reason": True}, (1.0, "True")),
        ({"index": 0, "score": 1, "reason": {}}, (1.0, "")),
        ({"index": 0, "score": 1, "reason": []}, (1.0, "")),
        (7, UNSCORED),
        ("text", UNSCORED),
        (None, UNSCORED),
    ],
)
def test_one_item(spark, item, expected):
    assert scores(spark, json.dumps({"scores": [3, item]})) == [expected, UNSCORED]


@pytest.mark.parametrize("reply", ["not json", "[]", "5", "null", "", None, '{"scores":{}}', '{"scores":null}', '{"scores":"ab"}', '{"x":1}'])
def test_unusable_reply(spark, reply):
    assert scores(spark, reply) == [UNSCORED, UNSCORED]


def test_last_item_wins_and_quoted_reply(spark):
    reply = json.dumps({"scores": [{"index": 1, "score": 0.2}, {"index": 1, "score": 0.3, "reason": "b"}]})
    assert scores(spark, reply) == [UNSCORED, (0.3, "b")]
    assert scores(spark, json.dumps(reply)) == [UNSCORED, (0.3, "b")]


def test_empty_batch_has_no_rows(spark):
    assert scores(spark, '{"scores":[]}', 0) == []


def test_reply_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", 2)], "reply string, n int")
    plan = R.parse_scores(df, batch_len="n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "size(transform" not in plan


def plan(spark, reply):
    text = reply if isinstance(reply, str) else json.dumps(reply)
    return R.parse_plan(spark.createDataFrame([(text,)], "reply string")).first()


def test_plan(spark):
    p = plan(spark, {"strategy": "clustering", "reasoning": " why ", "selection_rule": "r", "recommended_threshold": "0.7", "next_actions": ["a", " ", 5, None]})
    assert (p.strategy, p.reasoning, p.recommended_threshold, p.next_actions, p.error) == ("clustering", "why", 0.7, ["a", "5", "None"], None)


@pytest.mark.parametrize("strategy", ["magic", 5, None, "Scoring"])
def test_plan_unknown_strategy(spark, strategy):
    assert plan(spark, {"strategy": strategy, "reasoning": "x", "selection_rule": "r"}).strategy == "scoring"


@pytest.mark.parametrize("value, expected", [(7, 1.0), (-1, 0.0), ("high", None), (None, None), (True, 1.0), ([], None)])
def test_plan_threshold(spark, value, expected):
    assert plan(spark, {"reasoning": "x", "selection_rule": "r", "recommended_threshold": value}).recommended_threshold == expected


@pytest.mark.parametrize(
    "reply, error",
    [
        ("{broken", "not valid JSON"),
        ([1], "not a JSON object"),
        ({"reasoning": "x"}, "missing reasoning or selection rule"),
        ({"reasoning": " ", "selection_rule": "r"}, "missing reasoning or selection rule"),
    ],
)
def test_plan_errors(spark, reply, error):
    p = plan(spark, reply)
    assert p.error == error and p.strategy is None and p.next_actions is None


RESPONSES = [
    (None, "timeout"), (200, '{"result":7}'), (200, "[]"), (200, "5"), (204, ""), (200, "<html>"), (301, "{}"),
    (200, '{"error":"NOT_FOUND","error_description":"gone"}'), (200, '{"error":"ERROR_METHOD_NOT_FOUND"}'),
    (200, '{"error":"LIMIT"}'), (200, '{"error":null}'), (400, "{}"), (401, "{}"), (403, "{}"), (404, "{}"), (500, "x"), (599, "x"),
]


def test_response_rule_is_the_same_in_tasks_and_tables(spark):
    destination = Destination("bitrix24", "lead", "https://example.com", "t")
    df = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(RESPONSES)], "i int, status int, body string")
    found = R.classify_responses(df).orderBy("i").collect()
    assert [r.outcome for r in found] == [judge(destination, s, b).outcome for s, b in RESPONSES]


def test_echoed_items(spark):
    df = spark.createDataFrame([('{"_embedded":{"leads":[{"id":1},{"id":2}]}}',), ("{}",), ("x",)], "b string")
    assert [r[0] for r in df.select(R.echoed_items(F.col("b"), "leads")).collect()] == [2, 0, 0]
