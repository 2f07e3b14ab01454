from __future__ import annotations

from rowferry.operators.integrity import agent_integrity, spec_integrity

ITEMS = "array<struct<source_field:string,destination_field:string,transformation:string>>"


def specs(spark, mapping=None, sync=None, source_type="postgres", destination_type="bitrix24"):
    sources = spark.createDataFrame([(1, "s", source_type)], "source_id long, name string, type string")
    destinations = spark.createDataFrame([(1, "d", destination_type)], "destination_id long, name string, type string")
    m = dict(mapping_id=1, source_id=1, source_table="contacts", destination_type="bitrix24", destination_entity="lead", field_mappings=[("a", "A", "")])
    mappings = spark.createDataFrame(
        [tuple((m | (mapping or {})).values())],
        f"mapping_id long, source_id long, source_table string, destination_type string, destination_entity string, field_mappings {ITEMS}",
    )
    y = dict(sync_id=1, name="y", source_id=1, destination_id=1, mapping_id=1, interval_value=1, interval_unit="hours", run_at_time=None, status="active")
    syncs = spark.createDataFrame(
        [tuple((y | (sync or {})).values())],
        "sync_id long, name string, source_id long, destination_id long, mapping_id long, interval_value int, interval_unit string, run_at_time string, status string",
    )
    return sources, destinations, mappings, syncs


def rules(spark, **more):
    return sorted(r.rule for r in spec_integrity(*specs(spark, **more)).collect())


def test_sound_specs(spark):
    assert rules(spark) == []


def test_single_faults(spark):
    assert rules(spark, source_type="mysql") == ["source_type"]
    assert rules(spark, mapping={"source_table": "users; DROP"}) == ["identifier"]
    assert rules(spark, mapping={"field_mappings": []}) == ["empty_mapping"]
    assert rules(spark, mapping={"field_mappings": [("a", None, "trim"), ("a", "B", "shout")]}) == ["incomplete_item", "unknown_preset"]
    assert rules(spark, mapping={"destination_entity": "leads"}) == ["unknown_entity"]
    assert rules(spark, mapping={"source_id": 2}) == ["foreign_mapping"]
    assert rules(spark, sync={"interval_value": 168}) == []
    assert rules(spark, sync={"interval_value": 91, "interval_unit": "days", "run_at_time": "9:00"}) == ["interval_bounds", "run_at_time"]
    assert rules(spark, sync={"status": "archived", "destination_id": 5}) == ["missing_destination", "unknown_status"]
    assert rules(spark, sync={"mapping_id": 5, "source_id": 5}) == ["missing_mapping", "missing_source"]


def test_nulls_are_not_fine(spark):
    assert rules(spark, source_type=None) == ["source_type"]
    assert rules(spark, destination_type=None) == ["destination_type"]
    assert rules(spark, mapping={"field_mappings": None}) == ["empty_mapping"]
    assert rules(spark, mapping={"destination_entity": None}) == ["unknown_entity"]
    assert rules(spark, mapping={"destination_type": None}) == ["unknown_entity"]
    assert rules(spark, mapping={"source_table": None}) == ["identifier"]
    assert rules(spark, sync={"status": None}) == ["unknown_status"]
    assert rules(spark, sync={"interval_value": None}) == rules(spark, sync={"interval_unit": None}) == ["interval_bounds"]
    assert rules(spark, sync={"source_id": None}) == ["foreign_mapping", "missing_source"]


def test_every_owner_of_a_shared_name_is_reported(spark):
    sources, destinations, mappings, syncs = specs(spark)
    more = sources.unionAll(sources.selectExpr("source_id + 1", "name", "type")).unionAll(sources.selectExpr("source_id + 2", "name", "type"))
    found = spec_integrity(more, destinations, mappings, syncs).collect()
    assert sorted((r.rule, r.table_name, r.id, r.detail) for r in found) == [("duplicate_name", "sources", i, "s") for i in (1, 2, 3)]


def test_agents(spark):
    _, destinations, mappings, _ = specs(spark)
    agents = spark.createDataFrame(
        [(1, 1, 1, "ready", "scoring", 0.6), (2, 9, 9, "active", "magic", 1.5)],
        "agent_id long, destination_id long, mapping_id long, status string, strategy string, threshold double",
    )
    found = agent_integrity(destinations, mappings, agents).collect()
    assert {r.rule for r in found} == {"unknown_status", "unknown_strategy", "threshold_bounds", "missing_destination", "missing_mapping"}
    assert {r.id for r in found} == {2}
