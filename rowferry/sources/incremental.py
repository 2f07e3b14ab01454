"""Reading only what is new, and remembering how far the read got."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .relations import check_identifier


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a table is not there yet; any other error must not pass for that."""
    return error.getCondition() == "PATH_NOT_FOUND"


def newer_than(df: DataFrame, field: str | None, last: object | None, inclusive: bool = False) -> DataFrame:
    """Rows past the watermark; everything where there is no field or no last run.

    Rows without a value in the field come with the full read only. With
    ``inclusive`` the rows at the watermark come again: pair it with a
    collapse by key, and ties at the boundary are not lost.
    """
    if not field or last is None:
        return df
    column = F.col(f"`{check_identifier(field)}`")
    return df.where(column >= _bound(df, field, last) if inclusive else column > _bound(df, field, last))


def _bound(df: DataFrame, field: str, last: object) -> Column:
    """The watermark in the column's own type, so that the filter reaches the scan."""
    dtype = df.schema[field].dataType
    if isinstance(last, datetime) and isinstance(dtype, T.TimestampNTZType):
        # An aware moment is compared by its UTC wall clock.
        if last.tzinfo is not None:
            last = datetime.fromtimestamp(last.timestamp(), tz=timezone.utc).replace(tzinfo=None)
        return F.lit(last.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(last, datetime) and isinstance(dtype, T.StringType):
        return F.lit(last.isoformat())
    return F.lit(last).cast(dtype)


def next_watermark(df: DataFrame, field: str) -> DataFrame:
    """One row: how many rows were read and the highest value among them."""
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.max(f"`{field}`").alias("watermark"))


class WatermarkLog:
    """Append-only parquet table of committed watermarks, one small row per run."""

    # ``written`` (nanoseconds) orders the rows even where two runs give the same time.
    SCHEMA = "owner string, watermark string, committed_at timestamp_ntz, written long"

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def commit(self, owner: str, watermark: object, at: datetime) -> None:
        text = watermark.isoformat(sep=" ") if isinstance(watermark, datetime) else str(watermark)
        row = [(owner, text, at.replace(tzinfo=None), time.time_ns())]
        frame = self._spark.createDataFrame(row, self.SCHEMA).coalesce(1)
        # A folder per owner: looking up one owner reads only its rows.
        frame.write.mode("append").partitionBy("owner").parquet(self._path)

    def latest(self, owner: str) -> str | None:
        """The watermark committed last, as text; it is cast to the field's type on use."""
        try:
            log = self._spark.read.schema(self.SCHEMA).parquet(self._path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None  # no run yet
        row = log.where(F.col("owner") == owner).agg(F.max_by("watermark", "written")).first()
        return row[0]
