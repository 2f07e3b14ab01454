"""Plain descriptions of what to run: field maps, syncs and selection agents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

# Preset names as they are stored in saved mappings.
PRESETS = ("lowercase", "uppercase", "trim", "to_string", "to_number", "parse_date")

# Connector types and the entities each destination knows.
SOURCE_TYPES = ("postgres", "clickhouse")
DESTINATION_ENTITIES = {
    "bitrix24": ("lead", "contact", "company", "deal"),
    "amocrm": ("leads", "contacts", "companies", "tasks"),
}
DESTINATION_TYPES = tuple(DESTINATION_ENTITIES)

# Statuses, units and strategies as stored in the spec tables.
SYNC_STATUSES = ("active", "paused", "inactive")
AGENT_STATUSES = ("draft", "ready", "archived")
INTERVAL_UNITS = ("hours", "days")
STRATEGIES = ("scoring", "clustering", "rule_based")

DEFAULT_THRESHOLD = 0.6
DEFAULT_RUN_AT = "09:00"
MAX_INTERVAL = {"hours": 168, "days": 90}


@dataclass(frozen=True)
class FieldMap:
    """One source column, the destination field it fills, and an optional preset."""

    source_field: str
    destination_field: str
    transformation: str | None = None


def field_maps(items: Iterable[dict]) -> tuple[FieldMap, ...]:
    """Field maps from stored mapping items; each needs both names."""
    maps = []
    for item in items:
        if not item.get("source_field") or not item.get("destination_field"):
            raise ValueError(f"a mapping item needs source_field and destination_field: {item!r}")
        maps.append(FieldMap(item["source_field"], item["destination_field"], item.get("transformation")))
    return tuple(maps)


@dataclass(frozen=True)
class SyncSpec:
    """One scheduled copy of a table into an entity of a destination."""

    sync_id: int
    name: str
    field_mappings: tuple[FieldMap, ...]
    destination_type: str
    entity: str
    incremental_field: str | None = None
    last_run: datetime | None = None
    next_run: datetime | None = None
    interval_value: int = 1
    interval_unit: str = "hours"
    run_at_time: str | None = None
    # Columns that identify a source row; they make the idempotency key of a
    # create and break ties between two versions of one record.
    key_columns: tuple[str, ...] = ()
    # "data": the watermark is max(incremental_field) of the rows read, kept
    # after a successful write only. "run_clock": the finish time of the run,
    # kept also after a failure.
    watermark_mode: str = "data"


@dataclass(frozen=True)
class AgentSpec:
    """A goal-driven selection in front of the same write."""

    agent_id: int
    name: str
    goal: str
    actions: str
    field_mappings: tuple[FieldMap, ...]
    destination_type: str
    entity: str
    strategy: str = "scoring"
    threshold: float = DEFAULT_THRESHOLD
    incremental_field: str | None = None
    last_run: datetime | None = None
    status: str = "draft"
    selection_rule: str | None = None
    feature_notes: dict[str, str] = field(default_factory=dict)
    key_columns: tuple[str, ...] = ()
    watermark_mode: str = "data"

    @property
    def rule_in_force(self) -> str:
        """The rule of the plan, or the goal where the plan has none. Without a plan the rule is None."""
        return self.selection_rule or self.goal
