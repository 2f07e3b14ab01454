"""A global position per row, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def row_index(
    df: DataFrame, *order: str, partitions: int | None = None, name: str = "row_index", unique: bool = True
) -> DataFrame:
    """``name`` = 0, 1, 2, … in the order of the given columns.

    Steps: range-partition and sort, number the rows inside each partition, add
    the number of rows in the partitions before. The sorted frame is
    staged in the shared folder, because partition number and row number must be the same in
    both passes, also after a lost executor. Only one row per partition is
    shuffled for the offsets.

    The columns should identify a row. Where they do not, rows that agree in
    all of them get neighbouring numbers in no particular order; say
    ``unique=False`` if many may agree. Range partitioning cannot cut through
    equal rows, so they get a running number first, taken from a staged copy
    of the input (a number taken from a live plan could change on a retry).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = list(order)
    if not unique:
        df = stage(df.withColumn("_copy", F.monotonically_increasing_id()), "copies")
        by.append("_copy")
    numbered = stage(
        df.repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_id", _LOCAL_BITS))
        .withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_id", "_copy"),
        "positions",
    )
    # One row per partition: n rows at most, so one window task is enough.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )
