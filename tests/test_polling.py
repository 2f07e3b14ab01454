from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowferry.streaming.polling import ParquetTable, polled

SCHEMA = "id bigint, stamp timestamp_ntz, note string"


def stamp(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def arrive(spark, path, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.option("parquet.block.size", 1024).mode("append").parquet(path)


def poll(spark, path, tmp, name, run=None, **options):
    stream = polled(spark, ParquetTable(path, "stamp", "id", **options), SCHEMA, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp}/checkpoint")
    writer = writer.format("parquet").option("path", f"{tmp}/out") if run is None else writer.foreachBatch(run)
    writer.start().awaitTermination()


def test_every_row_once_over_polls_and_restarts(spark, tmp_path):
    """Few stamps for many rows: each poll ends amid rows of one stamp, and the next one begins there."""
    choice, path = random.Random(1), str(tmp_path / "table")
    rows = sorted((stamp(choice.randrange(6)), i) for i in range(400))
    rows = [(i, when, f"n{i}") for when, i in rows]
    for first, end in ((0, 150), (150, 151), (151, 390), (390, 400)):
        arrive(spark, path, rows[first:end])
        poll(spark, path, tmp_path, "polled_once", split_rows=40)
        if end == 150:
            poll(spark, path, tmp_path, "polled_once", split_rows=40)  # nothing new
        found = spark.read.parquet(f"{tmp_path}/out").collect()
        assert sorted((r["id"], r["stamp"], r["note"]) for r in found) == sorted(rows[:end])


def test_a_failed_batch_is_read_again(spark, tmp_path):
    path, seen = str(tmp_path / "table"), []
    arrive(spark, path, [(i, stamp(i // 4), "a") for i in range(10)])

    def run(batch, number):
        ids = sorted(r["id"] for r in batch.collect())
        seen.append((number, ids))
        if len(seen) == 1:
            raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        poll(spark, path, tmp_path, "polled_again", run)
    # What arrives meanwhile belongs to the next batch: the range of the failed one is in the checkpoint.
    arrive(spark, path, [(i, stamp(i // 4), "b") for i in range(10, 14)])
    poll(spark, path, tmp_path, "polled_again", run)
    poll(spark, path, tmp_path, "polled_again", run)
    assert seen[:2] == [(0, list(range(10)))] * 2 and sorted(sum((ids for _, ids in seen[2:]), [])) == list(range(10, 14))


def test_marks_and_splits(spark, tmp_path):
    path = str(tmp_path / "table")
    table = ParquetTable(path, "stamp", "id", split_rows=1)
    assert table.newest() is None
    arrive(spark, path, [(1, stamp(1), "a"), (None, stamp(2), "b"), (2, None, "c"), (7, stamp(2), "d"), (9, stamp(0), "e")])
    micros = lambda minute: (stamp(minute) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert table.newest() == (micros(2), 7)

    def notes(after, upto):
        return sorted(n for s in table.splits(after, upto) for b in table.read(s, ["note"]) for n in b.column(0).to_pylist())

    assert notes(None, table.newest()) == ["a", "b", "d", "e"]
    assert notes((micros(1), 1), table.newest()) == ["b", "d"] and notes((micros(1), 0), table.newest()) == ["a", "b", "d"]
    assert notes((micros(2), None), table.newest()) == ["d"] and notes(table.newest(), table.newest()) == []
    assert len(table.splits(None, table.newest())) > 1 and table.splits((micros(3), 0), (micros(4), 0)) == []


def test_other_columns_to_poll_by(spark, tmp_path):
    rows = spark.range(20).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("string").alias("name"), F.col("id").cast("double").alias("size"))
    rows.write.parquet(str(tmp_path / "t"))
    assert ParquetTable(str(tmp_path / "t"), "day", "name").newest() == (19742, "19")
    assert ParquetTable(str(tmp_path / "t"), "name", "id").newest() == ("9", 9)
    with pytest.raises(ValueError, match="double"):
        ParquetTable(str(tmp_path / "t"), "size", "id").newest()
