"""The registered queries: each a Spark function and, where SQL can say it, its oracle."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import activation, delivery, incremental, presets, replies, runs, scans, schedule, selection, specs, suggest, upsert  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
