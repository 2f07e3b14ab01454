"""Payloads as parquet files, one folder per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.mapping import Record
from ..operators.upsert import batch_items, record_calls
from .delivery import Delivered


class FileSink:
    """Writes (call_key, op, method, payload); sending is left to whoever reads them.

    The folder of a run is overwritten when the run is repeated, so a replayed
    micro-batch leaves the same files, not twice the rows.
    """

    def __init__(self, path: str, type: str = "bitrix24"):
        self.path, self.type = path, type

    def deliver(self, df: DataFrame, record: Record, entity: str, key: Column | None, run_id: str) -> Delivered:
        keyed = df.withColumn("_key", F.lit(None).cast("string") if key is None else key)
        if self.type == "bitrix24":
            calls = record_calls(keyed, record, entity, keep=("_key",))
        else:
            calls = batch_items(keyed, record, keep=("_key",)).select(
                "_key", "op", F.lit(None).cast("string").alias("method"), F.col("item").alias("payload"), "unsendable"
            )
        seen = Observation()
        odd = F.count_if("unsendable")
        (
            calls.observe(seen, F.count(F.lit(1)).alias("n"), odd.alias("odd"))
            .where(~F.col("unsendable"))
            .select(F.col("_key").alias("call_key"), "op", "method", "payload")
            .write.mode("overwrite")
            .parquet(f"{self.path}/run={run_id}")
        )
        n, odd = seen.get["n"], seen.get["odd"]
        error = "a field holds NaN or infinity, which JSON cannot carry" if odd else None
        return Delivered(written=n - odd, failed=odd, error=error)
