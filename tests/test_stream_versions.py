from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowferry.streaming.versions import ROCKSDB, newest_versions

SCHEMA = "id bigint, kind string, at timestamp_ntz, note string"


def at(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def passed(spark, tmp_path, batches, keep):
    """What leaves the stream for each micro-batch; every batch is a start of its own."""
    files, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(files)
        stream = spark.readStream.schema(SCHEMA).parquet(files)
        got = []
        writer = newest_versions(stream, ["id", "kind"], "at", keep).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.foreachBatch(lambda batch, n: got.extend(tuple(r) for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()
        out.append(got)
    return out


def expected(batches, keep):
    """By the definition, without dropping any state."""
    sent, newest, out = {}, None, []
    for rows in batches:
        best = {}
        for row in rows:
            if row[0] is None or row[1] is None or row[2] is None:
                continue
            if newest is not None and row[2] <= newest - keep:
                continue
            key = row[:2]
            if (key not in sent or row[2] > sent[key]) and (key not in best or row[2] > best[key][2]):
                best[key] = row
        sent |= {key: row[2] for key, row in best.items()}
        stamps = [r[2] for r in rows if None not in r[:3]]
        newest = max([*stamps, *([newest] if newest else [])], default=newest)
        out.append([row[:3] for row in best.values()])
    return out


def test_against_the_definition(spark, tmp_path, rocksdb):
    choice = random.Random(3)
    batches = []
    for n in range(4):
        middle = n * 60
        rows = [(choice.randrange(8), choice.choice("ab"), at(middle + choice.randrange(-150, 60)), f"{n}/{i}") for i in range(60)]
        rows += [(1, "hot", at(middle + choice.randrange(-20, 20)), f"h{i}") for i in range(200)]
        batches.append([*rows, (None, "a", at(0), "x"), (1, None, at(0), "x"), (1, "a", None, "x")])
    batches.append(batches[1])  # all of it again, and late
    found = passed(spark, tmp_path, batches, "60 minutes")
    assert [sorted(r[:3] for r in rows) for rows in found] == [sorted(rows) for rows in expected(batches, dt.timedelta(minutes=60))]
    assert all(sum(map(len, found[:n])) for n in (1, 2, 3))


def test_records_that_share_state(spark, tmp_path, rocksdb, monkeypatch):
    """Few slots and small frames: a slot holds many records, a record comes in several frames, some versions have been passed."""
    monkeypatch.setattr("rowferry.streaming.versions.SLOTS", 3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    choice = random.Random(5)
    batches = [
        [(choice.randrange(60), choice.choice("ab"), at(n * 50 + choice.randrange(-120, 60)), f"{n}/{i}") for i in range(150)] for n in range(4)
    ]
    batches.append(batches[2])
    try:
        found = passed(spark, tmp_path, batches, "60 minutes")
    finally:
        spark.conf.set(name, before)
    assert [sorted(r[:3] for r in rows) for rows in found] == [sorted(rows) for rows in expected(batches, dt.timedelta(minutes=60))]


def test_state_has_few_keys_for_many_records(spark, tmp_path, rocksdb, monkeypatch):
    """The state is read and written by slot: a call per record takes milliseconds, so millions of records would not end."""
    monkeypatch.setattr("rowferry.streaming.versions.SLOTS", 16, raising=False)
    files = str(tmp_path / "in")
    spark.range(20_000).selectExpr("id", "'a' AS kind", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at", "'' AS note").write.parquet(files)
    stream = spark.readStream.schema(SCHEMA).parquet(files)
    writer = newest_versions(stream, ["id"], "at", "60 minutes").writeStream.format("parquet")
    running = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    running.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count_distinct("id")).first()[0] == 20_000
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress) <= 100


def test_other_state_stores_are_refused(spark, tmp_path):
    stream = spark.readStream.format("rate").load().selectExpr("value AS id", "timestamp AS at")
    with pytest.raises(ValueError, match="RocksDB"):
        newest_versions(stream, ["id"], "at")


def test_compacting_the_log_of_versions(spark, tmp_path):
    """What a crash leaves beside the new folder, or two compactions in a row, change nothing."""
    from rowferry.streaming import VersionLog

    log = VersionLog(spark, str(tmp_path / "log"))
    log.compact()
    assert log.latest() is None
    schema = "id bigint, version timestamp_ntz"
    log.commit(spark.createDataFrame([(1, at(1)), (2, at(5))], schema), 0)
    log.commit(spark.createDataFrame([(1, at(3)), (3, at(2))], schema), 1)
    known = sorted(tuple(r) for r in log.latest().collect())
    for _ in range(2):
        log.compact()
        assert sorted(tuple(r) for r in log.latest().collect()) == known == [(1, at(3)), (2, at(5)), (3, at(2))]
        assert len(list((tmp_path / "log").glob("batch=*"))) == 1
    log.commit(spark.createDataFrame([(1, at(2)), (2, at(9))], schema), 0)  # an old batch once more
    assert {r["id"]: r["version"] for r in log.latest().collect()} == {1: at(3), 2: at(9), 3: at(2)}
