from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowferry.sinks.crm import RESULT_SCHEMA
from rowferry.sinks.sent import SentKeys


def results(spark, path, run, rows):
    frame = spark.createDataFrame([(keys, op, outcome, len(keys or ()), None, 0) for keys, op, outcome in rows], RESULT_SCHEMA)
    frame.write.parquet(f"{path}/run={run}")


def calls(spark, keys, op="create"):
    return spark.createDataFrame([(k, op, f"p{k}") for k in keys], "call_key string, op string, payload string")


def left(index, frame):
    rows = index.mark_sent(frame).collect()
    assert len(rows) == frame.count()
    return sorted(str(r["call_key"]) for r in rows if r["op"] != "skipped"), sum(r["op"] == "skipped" for r in rows)


def test_keys_of_all_runs_are_left_out_once(spark, tmp_path):
    path = str(tmp_path / "results")
    index = SentKeys(spark, path, RESULT_SCHEMA, buckets=5)
    assert left(index, calls(spark, ["a", "b", None])) == (["None", "a", "b"], 0)
    results(spark, path, "1", [(["a", "b"], "create", "written"), (["c"], "create", "failed"), (["d"], "update", "written"), (None, "create", "written")])
    index.add(["run=1"])
    # Found again by a new session's index, whatever number of buckets it asks for.
    index = SentKeys(spark.newSession(), path, RESULT_SCHEMA, buckets=9)
    results(spark, path, "2", [(["e", None], "create", "partial"), (["a"], "create", "written")])  # not indexed: the job ended
    assert left(index, calls(index._spark, ["a", "b", "c", "d", "e", "f", None, "a"])) == (["None", "c", "d", "f"], 4)
    assert left(index, calls(index._spark, ["a"], op="update")) == (["a"], 0)
    index.add(["run=2"])  # twice
    assert left(index, calls(index._spark, ["a", "e", "x"])) == (["x"], 2)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_the_index_is_not_shuffled(spark, tmp_path, adaptive):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", adaptive)
    path = str(tmp_path / "results")
    results(session, path, "1", [([f"k{i}" for i in range(50)], "create", "written")])
    index = SentKeys(session, path, RESULT_SCHEMA)
    frame = index.mark_sent(calls(session, [f"k{i}" for i in range(0, 100, 2)]))
    assert frame.where("op = 'skipped'").count() == 25 and len(frame.collect()) == 50
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if "== Initial Plan ==" in plan:
        plan = plan.split("== Initial Plan ==")[0]
    # One exchange: of the calls. The keys are made distinct and joined where they lie.
    assert plan.count("Exchange hashpartitioning(call_key") == plan.count("Exchange") == 1 and "Bucketed: true" in plan
