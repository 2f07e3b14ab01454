"""Keys of creates that got through, as a table bucketed by key.

The results of a run are the record of what was sent; this table is an index over them. It is
bucketed, so comparing a run's creates with years of sent keys moves the run's rows only: the index is read where it
lies, without an exchange. Result folders that are not indexed yet (the job ended between the two writes) are
taken in before the next comparison, so no sent key is missed. A folder that is indexed twice does no harm.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import entries, exists
from ..sources.incremental import is_missing_path
from .delivery import SKIPPED, DeliveryError


class SentKeys:
    """Index of the result folders below ``results_path``, kept beside it in ``<results_path>_sent``.

    ``buckets`` counts for a new index only; an existing one keeps its number. Choose as many as the largest
    join with it should have tasks, at least ``spark.sql.shuffle.partitions``, below which Spark prefers to shuffle both sides.
    """

    def __init__(self, spark: SparkSession, results_path: str, results_schema: str, buckets: int | None = None):
        self._spark, self._results, self._schema = spark, results_path.rstrip("/"), results_schema
        self._path = f"{self._results}_sent"
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self._spark.read.schema(schema).parquet(f"{self._path}/{name}")
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None

    def _table(self) -> str:
        """The bucketed table over the index's files, known to this session."""
        told = self._read("buckets", "buckets int")
        if told is None:
            self._spark.createDataFrame([(self._buckets,)], "buckets int").coalesce(1).write.parquet(f"{self._path}/buckets")
        else:
            self._buckets = told.first()[0]
        name = f"rowferry_sent_{zlib.crc32(self._path.encode()):08x}_{self._buckets}"
        place = self._path.replace("'", "\\'")
        self._spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (sent_key STRING) USING parquet "
            f"CLUSTERED BY (sent_key) INTO {self._buckets} BUCKETS LOCATION '{place}/keys'"
        )
        return name

    def add(self, folders: list[str]) -> None:
        """Take in the creates that result folders say were written."""
        if not folders:
            return
        results = self._spark.read.schema(self._schema).parquet(*[f"{self._results}/{f}" for f in folders])
        done = results.where(F.col("outcome").isin("written", "partial") & (F.col("op") == "create"))
        keys = done.select(F.explode("call_keys").alias("sent_key")).where(F.col("sent_key").isNotNull())
        # One file per bucket and run.
        keys.repartition(self._buckets, "sent_key").write.mode("append").insertInto(self._table())
        # A folder that is still being written may hold more later.
        whole = [(f,) for f in folders if exists(self._spark, f"{self._results}/{f}/_SUCCESS")]
        if whole:
            self._spark.createDataFrame(whole, "folder string").coalesce(1).write.mode("append").parquet(f"{self._path}/folders")

    def catch_up(self) -> bool:
        """Take in what is not indexed yet; whether there is an index at all."""
        there = entries(self._spark, self._results)
        if strange := [name for name in there if not re.fullmatch(r"run=.*/", name)]:
            # Only a folder of results, or none at all, may pass for what was sent.
            raise DeliveryError(f"{self._results} holds something else than results of runs: {strange[0]}")
        known = self._read("folders", "folder string")
        indexed = set() if known is None else {r["folder"] for r in known.collect()}  # one row per run
        self.add([name[:-1] for name in there if name[:-1] not in indexed])
        return bool(there)

    def mark_sent(self, calls: DataFrame, key: str = "call_key") -> DataFrame:
        """The calls, with the op ``skipped`` for creates that were sent before. They stay as rows, so whoever sends the
        others counts them, and the input is planned and read once."""
        if not self.catch_up():
            return calls
        sent = self._spark.table(self._table()).distinct()
        flagged = calls.join(sent, (F.col(key) == F.col("sent_key")) & (F.col("op") == "create"), "left")
        op = F.when(F.col("sent_key").isNotNull(), SKIPPED).otherwise(F.col("op"))
        return flagged.withColumn("op", op).select(*calls.columns)
