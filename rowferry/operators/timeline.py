"""Joins and counts along time, cut by time ranges, so that one group with most of all rows is not one task.

Rows are range-partitioned by (group, time) and sorted. Each partition is worked through once, as if
nothing stood before it; what it leaves open at its beginning, and what it hands on at its end,
is one row per partition (and group). These few rows are carried along each group and put
in at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

from ..session import stage


def _new_groups(group: pa.Array, before: str | None) -> np.ndarray:
    """Whether each row begins a group; ``before`` is the group of the row before the first."""
    last = pa.concat_arrays([pa.array([before], pa.string()), group.slice(0, len(group) - 1)])
    return pc.fill_null(pc.not_equal(group, last), True).to_numpy(zero_copy_only=False)


_HEAD, _ROW, _TAIL = 0, 1, 2


def _latest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (part, group, kind, l, r) rows: the left rows with the last right row before them in the partition, and
    the partition's head (its first group) and tail (its last group, and that one's last right row)."""
    group = carried = part = first = None  # carried: the last right row of the open group, an array of one
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, kinds, left, right = (batch.column(i) for i in (1, 2, 3, 4))
        count, schema = batch.num_rows, batch.schema
        if part is None:
            part, first = batch.column(0)[0].as_py(), groups[0].as_py()
            carried = pa.nulls(1, right.type)
            yield _row(part, first, _HEAD, pa.nulls(1, left.type), carried, False)
        new = _new_groups(groups, group)
        places = np.arange(count)
        start = np.maximum.accumulate(np.where(new, places, -1))  # -1: the group goes on from the batch before
        last = np.maximum.accumulate(np.where(kinds.to_numpy() == 0, places, -1))
        inside = (last >= start) & (last >= 0)
        # Place 0 is what the batch before handed on, place 1 nothing.
        chosen = np.where(inside, last + 2, np.where(start < 0, 0, 1))
        pool = pa.concat_arrays([carried, pa.nulls(1, right.type), right])
        rows = np.flatnonzero(kinds.to_numpy() == 1)
        if len(rows):
            found = pool.take(pa.array(chosen[rows]))
            # Only the partition's first group may have rows in the partitions before.
            unknown = pc.and_(pc.is_null(found), pc.equal(groups.take(pa.array(rows)), first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), groups.take(pa.array(rows)), pa.array(np.full(len(rows), _ROW, np.int32)),
                 left.take(pa.array(rows)), found, unknown], _NAMES)
        carried = pool.take(pa.array([chosen[-1]]))
        group = groups[count - 1].as_py()
    if part is not None:
        yield _row(part, group, _TAIL, pa.nulls(1, left.type), carried, False)


_NAMES = ["part", "grp", "what", "l", "r", "unknown"]


def _row(part: int, group: str, what: int, left: pa.Array, right: pa.Array, unknown: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([group], pa.string()), pa.array([what], pa.int32()), left, right, pa.array([unknown])], _NAMES
    )


def latest_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, out: str = "latest") -> DataFrame:
    """The rows of ``left`` with the latest row of ``right`` at or before their time, among those of the same ``by``, as the
    struct ``out``; null without one.

    Of right rows of one time the greatest counts. Rows of ``left`` with a null in ``by`` or in the time have none; such rows of
    ``right`` are left out. Repeated rows stay. One shuffle of both sides, by time ranges.
    """
    def known(time: str):
        complete = F.col(time).isNotNull()
        for column in by:
            complete &= F.col(column).isNotNull()
        return complete

    group = F.to_json(F.struct(*by))
    slots = (
        right.where(known(right_time))
        .groupBy(group.alias("grp"), F.col(right_time).alias("time"))
        .agg(F.max(F.struct(*right.columns)).alias("r"))
    )
    l_type, r_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType, slots.schema["r"].dataType
    both = (
        left.where(known(left_time))
        .select(group.alias("grp"), F.col(left_time).alias("time"), F.lit(1).alias("kind"), F.struct(*left.columns).alias("l"))
        .withColumn("r", F.lit(None).cast(r_type))
        # Many rows of one time are cut as well.
        .withColumn("spread", F.xxhash64("l"))
        .unionByName(
            slots.select("grp", "time", F.lit(0).alias("kind"), F.lit(None).cast(l_type).alias("l"), "r", F.lit(0).cast("bigint").alias("spread"))
        )
    )
    ranged = both.repartitionByRange("grp", "time", "kind", "spread").sortWithinPartitions("grp", "time", "kind", "spread")
    schema = StructType().add("part", IntegerType()).add("grp", StringType()).add("what", IntegerType())
    schema = schema.add("l", l_type).add("r", r_type).add("unknown", BooleanType())
    worked = stage(ranged.select(F.spark_partition_id().alias("part"), "grp", "kind", "l", "r").mapInArrow(_latest, schema), "latest")
    # Two rows per partition: along each group, the last right row before a partition begins.
    along = Window.partitionBy("grp").orderBy("part", "what").rowsBetween(Window.unboundedPreceding, -1)
    ends = worked.where(F.col("what") != _ROW).withColumn("before", F.last("r", ignorenulls=True).over(along))
    heads = ends.where(F.col("what") == _HEAD).select("part", "before")
    rows = worked.where(F.col("what") == _ROW)
    told = rows.where(~F.col("unknown")).select("l", "r")
    carried = rows.where("unknown").join(heads, "part").select("l", F.col("before").alias("r"))
    without = left.where(~F.coalesce(known(left_time), F.lit(False))).select(F.struct(*left.columns).alias("l"), F.lit(None).cast(r_type).alias("r"))
    return told.union(carried).union(without).select("l.*", F.col("r").alias(out))


def _peaks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (part, grp, us, change): per group of the partition the sum of changes, and the greatest running sum with its earliest time."""
    part = group = None
    total, peak, at = 0, None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([group], pa.string()), pa.array([total], pa.int64()), pa.array([peak], pa.int64()), pa.array([at], pa.int64())],
            ["part", "grp", "total", "peak", "at"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        us, change = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        starts = np.flatnonzero(_new_groups(batch.column(1), group))
        for first, end in zip([0, *starts], [*starts, len(us)]):
            if first == end:
                continue
            if first in starts:
                if group is not None:
                    yield row()
                group, total, peak, at = batch.column(1)[int(first)].as_py(), 0, None, None
            running = total + np.cumsum(change[first:end])
            best = int(running.argmax())
            if peak is None or running[best] > peak:
                peak, at = int(running[best]), int(us[first + best])
            total = int(running[-1])
    if group is not None:
        yield row()


def most_at_once(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by.., most, first_at): the greatest number of intervals open at one time, and when it is first reached.

    An interval holds its start, not its end; without an end it stays open. Intervals without a start, or that end
    where they begin or before, are open at no time; a group of such only has no row. Null groups are groups.
    The columns of ``by`` are numbers, texts, dates or booleans.
    """
    rows = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    marks = rows.select(*by, group.alias("grp"), us(start).alias("us"), F.lit(1).alias("change")).union(
        rows.where(F.col(end).isNotNull()).select(*by, group, us(end), F.lit(-1))
    )
    # Marks of one time are one change: ends and starts that fall together cancel out before the shuffle.
    changes = marks.groupBy("grp", "us").agg(F.sum("change").alias("change"))
    ranged = changes.repartitionByRange("grp", "us").sortWithinPartitions("grp", "us")
    parts = ranged.select(F.spark_partition_id().alias("part"), "grp", "us", "change").mapInArrow(
        _peaks, "part int, grp string, total bigint, peak bigint, at bigint"
    )
    along = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("peak", F.col("peak") + F.coalesce(F.sum("total").over(along), F.lit(0)))
    best = carried.groupBy("grp").agg(F.max(F.struct("peak", (-F.col("at")).alias("at"))).alias("best"))
    schema = rows.select(F.struct(*by).alias("b")).schema["b"].dataType
    moment = F.timestamp_micros(-F.col("best.at")).cast(intervals.schema[start].dataType)
    return best.select(F.from_json("grp", schema).alias("b"), F.col("best.peak").alias("most"), moment.alias("first_at")).select("b.*", "most", "first_at")
