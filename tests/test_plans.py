"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from rowferry.queries import QUERIES

# The queries whose work is a caller's Python function, a list cut by Python, or a running sum along sorted partitions.
PYTHON = {"score_batches", "payload_batches", "runs_concurrency"}


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"select_cluster"}))
def test_no_cross_join_and_no_stray_python(spark, folder, name):
    plan = executed(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("MapInPandas" in plan or "MapInArrow" in plan) == (name in PYTHON)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize(
    "name",
    [
        "scan_columns", "scan_where", "incremental_delta_pushed", "map_contacts", "activate_orders", "preset_trim", "preset_to_number",
        "preset_parse_date", "preset_to_string", "select_scoring", "select_rule", "reply_parse_scores", "reply_parse_plan",
        "reply_classify", "upsert_split_record", "payload_record", "payload_batches", "late_runs", "run_reports",
        "schedule_next", "schedule_skip_forward", "schedule_occurrences", "due_syncs", "upcoming_runs", "search_ilike",
    ],
)
def test_row_wise_queries_do_not_shuffle(spark, folder, name):
    assert "Exchange" not in executed(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["runs_recent", "runs_by_sync", "preview_rows", "selection_top5", "list_filtered"])
def test_pages_are_taken_not_sorted(spark, folder, name):
    plan = executed(QUERIES[name](spark, folder))
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["upsert_collapse", "suggest_validate", "runs_daily", "runs_count_by_sync"])
def test_groups_are_combined_before_the_shuffle(spark, folder, name):
    plan = executed(QUERIES[name](spark, folder))
    assert "partial_" in plan and "Window" not in plan
