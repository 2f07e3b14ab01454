"""Append-only run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYNC_RUN_SCHEMA = (
    "run_id string, sync_id long, status string, trigger string, started_at timestamp_ntz, finished_at timestamp_ntz, "
    "records_read long, records_written long, records_delivered long, records_unconfirmed long, records_skipped long, error_message string, next_run timestamp_ntz"
)
AGENT_RUN_SCHEMA = (
    "run_id string, agent_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz, "
    "rows_considered long, rows_selected long, rows_written long, rows_delivered long, "
    "rows_unconfirmed long, rows_skipped long, selection_summary string, error_message string"
)


class RunLog:
    """A parquet table that gets one row per run."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self._spark, self._path, self._schema = spark, path, schema

    def append(self, row: dict) -> None:
        frame = self._spark.createDataFrame([row], self._schema)
        frame.coalesce(1).write.mode("append").parquet(self._path)

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)
