"""The last version sent of each record, as keyed state of the stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Records share so many keys of state. A checkpoint belongs to one number: another number needs a new one.
SLOTS = 1 << 12
_ID, _VERSION, _TIME, _SLOT = "_record", "_sequence", "_event_time", "_slot"


def _packed(versions: dict[str, int]) -> bytes:
    batch = pa.record_batch([pa.array(versions.keys(), pa.string()), pa.array(versions.values(), pa.int64())], ["id", "version"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict[str, int]:
    table = pa.ipc.open_stream(packed).read_all()
    return dict(zip(table["id"].to_pylist(), table["version"].to_pylist()))


class _Newest(StatefulProcessor):
    """Keeps the greatest version of each record of a slot until the watermark has passed it."""

    def __init__(self, columns: list[str]):
        self._columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # ``expires`` is the time of the slot's timer.
        self._sent = handle.getValueState("slot", "versions binary, expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packed, expires = self._sent.get() or (None, None)
        known = _unpacked(packed) if packed is not None else {}
        kept, brought = [], {}  # rows newer than all before; the last frame that had such a row of a record
        for frame in rows:
            # By place: names that are no Python names do not arrive.
            versions, newer = frame.iloc[:, -2].tolist(), {}
            for at, record in enumerate(frame.iloc[:, -3].tolist()):
                if record not in known or versions[at] > known[record]:
                    known[record], newer[record] = versions[at], at
            if newer:
                kept.append((list(newer), frame.iloc[list(newer.values()), 1:-3].set_axis(self._columns, axis=1)))
                brought.update(dict.fromkeys(newer, len(kept) - 1))
        if not kept:
            return
        # Rows behind the watermark do not come in, so a version it has passed needs no state.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = {record: version for record, version in known.items() if version >= passed}
        until = max(known.values()) // 1000 + 1 if known else None
        if expires != until:
            if expires is not None:
                self._handle.deleteTimer(expires)
            if until is not None:
                self._handle.registerTimer(until)
        if known:
            self._sent.update((_packed(known), until))
        else:
            self._sent.clear()
        for number, (records, frame) in enumerate(kept):
            yield frame[[brought[record] == number for record in records]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer is that of the slot's newest version, so all others have been passed too.
        self._sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _last_of_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each record the last version in each Arrow batch: a record with very many rows leaves a task as a few."""
    for batch in batches:
        ids, rows = batch.column(_ID), pa.array(range(batch.num_rows), pa.int64())
        table = pa.table({"id": ids, "version": batch.column(_VERSION), "row": rows})
        newest = table.group_by("id").aggregate([("version", "max")])
        last = table.join(newest, ["id", "version"], ["id", "version_max"], "left semi")
        first = last.group_by("id").aggregate([("row", "min")])
        yield batch.take(first["row_min"].combine_chunks())


def newest_versions(stream: DataFrame, ids: list[str], version: str, keep: str = "7 days") -> DataFrame:
    """The rows that bring a record to a newer version than any row before; one row per record and micro-batch.

    ``version`` is a time. A row passes if it is newer than all that came before of its record (``ids``), and
    newer than ``keep`` before the newest row of all records in earlier batches: such rows are too
    late and are left out. So a record never goes back, and state that the watermark has passed is
    dropped without a difference. Repeated versions pass once; of rows of one version in one batch, any one. Rows with a
    null id or version are left out.

    State lies in RocksDB with the stream's checkpoint. Calling Python costs more than comparing versions, so records are
    dealt over ``SLOTS`` keys by their hash: a batch reads and writes the versions of the slots its records fall into, and
    a slot drops versions behind the watermark when it is next read, or all when its newest one has been passed.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    complete = F.col(version).isNotNull()
    for column in ids:
        complete &= F.col(column).isNotNull()
    moment = F.col(version).cast("timestamp")
    record = F.to_json(F.struct(*ids))
    slot = F.pmod(F.xxhash64(record), F.lit(SLOTS)).cast("int")
    named = stream.where(complete).select(
        slot.alias(_SLOT), "*", record.alias(_ID), F.unix_micros(moment).alias(_VERSION), moment.alias(_TIME)
    )
    last = named.mapInArrow(_last_of_batch, named.schema)
    return (
        last.withWatermark(_TIME, keep)
        .groupBy(_SLOT)
        .transformWithStateInPandas(
            statefulProcessor=_Newest(stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime"
        )
    )
