"""Rules between the spec tables, as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.relations import IDENTIFIER
from ..spec import (
    AGENT_STATUSES,
    DESTINATION_ENTITIES,
    DESTINATION_TYPES,
    MAX_INTERVAL,
    PRESETS,
    SOURCE_TYPES,
    STRATEGIES,
    SYNC_STATUSES,
)

# Fixed pattern: a time of day on a 24-hour clock.
TIME_OF_DAY = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"


def _row_rules(df: DataFrame, table: str, id_column: str, *rules: tuple[str, Column, Column]) -> DataFrame:
    """All (rule, condition, detail) that need nothing but the row, in one pass over the table."""
    broken = [
        F.when(condition, F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))
        for rule, condition, detail in rules
    ]
    return (
        df.select(F.col(id_column).cast("bigint").alias("id"), F.explode_outer(F.array(*broken)).alias("b"))
        .where(F.col("b").isNotNull())
        .select(F.col("b.rule"), F.lit(table).alias("table_name"), "id", F.col("b.detail"))
    )


def _violations(df: DataFrame, rule: str, table: str, id_column: str, condition: Column, detail: Column) -> DataFrame:
    return df.where(condition).select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table_name"),
        F.col(id_column).cast("bigint").alias("id"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
    )


def _not(fine: Column) -> Column:
    """Whether a value is not known to be fine: a null is not."""
    return ~F.coalesce(fine, F.lit(False))


def _duplicates(df: DataFrame, rule: str, table: str, id_column: str) -> DataFrame:
    """Every owner of a name in use more than once."""
    repeated = df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return _violations(df.join(repeated, "name", "left_semi"), rule, table, id_column, F.lit(True), F.col("name"))


def _dangling(df: DataFrame, other: DataFrame, rule: str, table: str, id_column: str, reference: str) -> DataFrame:
    lost = df.join(other.select(reference), reference, "left_anti")
    return _violations(lost, rule, table, id_column, F.lit(True), _reference(reference))


def _reference(name: str) -> Column:
    return F.concat(F.lit(f"{name} "), F.coalesce(F.col(name).cast("string"), F.lit("null")))


def spec_integrity(sources: DataFrame, destinations: DataFrame, mappings: DataFrame, syncs: DataFrame) -> DataFrame:
    """(rule, table_name, id, detail), one row per violation.

    sources (source_id, name, type), destinations (destination_id, name, type),
    mappings (mapping_id, source_id, source_table, destination_type,
    destination_entity, field_mappings array of source_field,
    destination_field, transformation), syncs (sync_id, name, source_id,
    destination_id, mapping_id, interval_value, interval_unit, run_at_time,
    status). Only ``run_at_time`` and a preset may be null.
    """
    entity_known = F.lit(False)
    for system, entities in DESTINATION_ENTITIES.items():
        entity_known = entity_known | ((F.col("destination_type") == system) & F.col("destination_entity").isin(*entities))
    text = lambda c: F.coalesce(c, F.lit(""))
    odd_name = lambda c: ~text(c).rlike(IDENTIFIER)
    value, unit = F.col("interval_value"), F.col("interval_unit")
    in_bounds = F.lit(False)
    for name, bound in MAX_INTERVAL.items():
        in_bounds = in_bounds | ((unit == name) & value.between(1, bound))
    none = F.lit("")
    items = F.explode("field_mappings").alias("m")
    source_field, preset = F.col("m.source_field"), F.col("m.transformation")
    # One left join per referenced table: what it finds tells a missing from a foreign row.
    there = lambda df, key: df.select(key, F.lit(True).alias(f"has_{key}"))
    owners = mappings.select("mapping_id", F.lit(True).alias("has_mapping_id"), F.col("source_id").alias("mapped_source_id"))
    joined = (
        syncs.join(there(sources, "source_id"), "source_id", "left")
        .join(there(destinations, "destination_id"), "destination_id", "left")
        .join(owners, "mapping_id", "left")
    )
    found = [
        _row_rules(sources, "sources", "source_id", ("source_type", _not(F.col("type").isin(*SOURCE_TYPES)), F.col("type"))),
        _row_rules(
            destinations, "destinations", "destination_id",
            ("destination_type", _not(F.col("type").isin(*DESTINATION_TYPES)), F.col("type")),
        ),
        _row_rules(
            mappings, "mappings", "mapping_id",
            ("identifier", odd_name(F.col("source_table")), F.col("source_table")),
            ("empty_mapping", F.coalesce(F.size("field_mappings"), F.lit(0)) <= 0, none),
            ("unknown_entity", _not(entity_known), F.col("destination_entity")),
        ),
        _row_rules(
            mappings.select("mapping_id", items), "mappings", "mapping_id",
            ("identifier", odd_name(source_field), source_field),
            ("incomplete_item", (text(source_field) == "") | (text(F.col("m.destination_field")) == ""), none),
            ("unknown_preset", (text(preset) != "") & ~preset.isin(*PRESETS), preset),
        ),
        _row_rules(
            joined, "syncs", "sync_id",
            ("unknown_status", _not(F.col("status").isin(*SYNC_STATUSES)), F.col("status")),
            ("interval_bounds", _not(in_bounds), F.concat_ws(" ", value.cast("string"), unit)),
            ("run_at_time", ~F.col("run_at_time").rlike(TIME_OF_DAY), F.col("run_at_time")),
            ("missing_source", F.col("has_source_id").isNull(), _reference("source_id")),
            ("missing_destination", F.col("has_destination_id").isNull(), _reference("destination_id")),
            ("missing_mapping", F.col("has_mapping_id").isNull(), _reference("mapping_id")),
            # A mapping belongs to one source; a sync that uses it must read from there.
            (
                "foreign_mapping",
                F.col("has_mapping_id") & ~F.col("source_id").eqNullSafe(F.col("mapped_source_id")),
                F.col("mapping_id"),
            ),
        ),
        _duplicates(sources, "duplicate_name", "sources", "source_id"),
        _duplicates(destinations, "duplicate_name", "destinations", "destination_id"),
    ]
    return reduce(DataFrame.unionAll, found)


def agent_integrity(destinations: DataFrame, mappings: DataFrame, agents: DataFrame) -> DataFrame:
    """The same table of violations for selection agents.

    agents (agent_id, destination_id, mapping_id, status, strategy, threshold).
    """
    threshold = F.col("threshold")
    found = [
        _row_rules(
            agents, "agents", "agent_id",
            ("unknown_status", _not(F.col("status").isin(*AGENT_STATUSES)), F.col("status")),
            ("unknown_strategy", _not(F.col("strategy").isin(*STRATEGIES)), F.col("strategy")),
            ("threshold_bounds", _not(threshold.between(0.0, 1.0)), threshold),
        ),
        _dangling(agents, destinations, "missing_destination", "agents", "agent_id", "destination_id"),
        _dangling(agents, mappings, "missing_mapping", "agents", "agent_id", "mapping_id"),
    ]
    return reduce(DataFrame.unionAll, found)
