"""A CRM as a streaming sink: a batch that is replayed adds no create.

Each task writes the key of every create that got through to a journal before it goes on, and leaves out the
creates whose key the journal has. A failed batch keeps its journal, so the next attempt, be it a task retried in the run or a
replay after a restart, goes on where it stopped. The commit of a batch names its journal files; they are
removed with the next commit only, since a batch that the destination has, but Spark has not
noted as done, comes again. The journal so holds the keys of one batch, not of the stream's history.

Keys are dealt to ``SLOTS`` slots by their CRC and rows to tasks by slot, so a task reads the
journal of its own slots only.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..files import file_system
from ..operators.mapping import Record
from ..operators.upsert import batch_items, record_calls
from .crm import require_entity
from .delivery import DeliveryError, Destination, Transport, http_transport, send_all

SLOTS = 256


def stream_rows(df: DataFrame, record: Record, type: str, entity: str, key: Column, parallelism: int = 1) -> DataFrame:
    """What the sink takes: (call_key, op, method, payload, unsendable), dealt to ``parallelism`` tasks by slot.

    For a destination of lists a row is one item; the sink makes the lists. Rows without a key
    have no protection against a replay; they are dealt by their payload.
    """
    keyed = df.withColumn("call_key", key)
    if type == "bitrix24":
        rows = record_calls(keyed, record, entity, keep=("call_key",))
    else:
        rows = batch_items(keyed, record, keep=("call_key",)).withColumnRenamed("item", "payload")
        rows = rows.withColumn("method", F.lit(None).cast("string"))
    slot = F.crc32(F.coalesce("call_key", "payload").cast("binary")) % SLOTS
    return rows.select("call_key", "op", "method", "payload", "unsendable").repartition(parallelism, slot)


@dataclass
class _Sent(WriterCommitMessage):
    files: list[str]


class Journal:
    """Keys of creates that got through, in files by slot; and per committed batch the files it has."""

    def __init__(self, path: str):
        self._path = path

    def _names(self, folder: str) -> list[str]:
        system, root = file_system(self._path)
        found = system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True, recursive=True))
        return sorted(f.path[len(root) + 1 :] for f in found if f.type == fs.FileType.File)

    def keys(self, slot: int) -> set[str]:
        system, root = file_system(self._path)
        found: set[str] = set()
        for name in self._names(f"keys/{slot:03d}"):
            with system.open_input_stream(f"{root}/{name}") as lines:
                # A line that was cut off by a crash has no end and counts for nothing.
                found.update(lines.read().decode().split("\n")[:-1])
        return found

    def open(self, slot: int):
        """(name, stream) of a new file."""
        system, root = file_system(self._path)
        name = f"keys/{slot:03d}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/keys/{slot:03d}", recursive=True)
        return name, system.open_output_stream(f"{root}/{name}")

    def commit(self, batch: int) -> None:
        """All files that no batch has yet belong to this one; those of earlier batches go."""
        system, root = file_system(self._path)
        owned: dict[int, list[str]] = {}
        for name in self._names("batches"):
            with system.open_input_stream(f"{root}/{name}") as text:
                written = text.read()
            try:
                owned[int(name.rsplit("/", 1)[1])] = json.loads(written)
            except ValueError:  # cut off by a crash: its files stay one batch longer
                owned[int(name.rsplit("/", 1)[1])] = []
        earlier = [(b, files) for b, files in owned.items() if b < batch]
        gone = {f for _, files in earlier for f in files}
        system.create_dir(f"{root}/batches", recursive=True)
        with system.open_output_stream(f"{root}/batches/{batch}") as out:
            out.write(json.dumps([n for n in self._names("keys") if n not in gone]).encode())
        # The files first: if the job ends in between, the batch's list still names them.
        there = set(self._names("keys"))
        for file in sorted(gone & there):
            system.delete_file(f"{root}/{file}")
        for b, _ in earlier:
            system.delete_file(f"{root}/batches/{b}")


class _CrmStreamWriter(DataSourceStreamWriter):
    def __init__(self, destination: Destination, names: list[str], transport: Transport, journal: Journal, batch_size: int):
        self.destination, self.names, self.transport = destination, names, transport
        self.journal, self.batch_size = journal, batch_size

    def _calls(self, rows) -> Iterator[tuple]:
        """Calls of what was not sent yet; lists are closed at ``batch_size`` items, one open list per op."""
        sent: dict[int, set[str]] = {}
        open_: dict[str, list] = {}

        def close(op: str) -> tuple:
            items = open_.pop(op)
            return [k for k, _, _ in items], op, None, f"[{','.join(p for _, p, _ in items)}]", any(odd for _, _, odd in items)

        for row in rows:
            value = dict(zip(self.names, row))
            key, op = value["call_key"], value["op"]
            if op == "create" and key is not None:
                slot = zlib.crc32(key.encode()) % SLOTS
                if slot not in sent:
                    sent[slot] = self.journal.keys(slot)
                if key in sent[slot]:
                    continue
            if self.destination.type == "bitrix24":
                yield [key], op, value["method"], value["payload"], value["unsendable"]
                continue
            items = open_.setdefault(op, [])
            items.append((key, value["payload"], value["unsendable"]))
            if len(items) == self.batch_size:
                yield close(op)
        for op in list(open_):
            yield close(op)

    def write(self, iterator) -> WriterCommitMessage:
        files: dict[int, tuple] = {}
        try:
            for keys, op, outcome, _, error, _ in send_all(self.destination, self.transport, self._calls(iterator)):
                if op == "create" and outcome in ("written", "partial"):
                    for key in keys:
                        if key is not None:
                            slot = zlib.crc32(key.encode()) % SLOTS
                            if slot not in files:
                                files[slot] = self.journal.open(slot)
                            files[slot][1].write(f"{key}\n".encode())
                            files[slot][1].flush()
                if outcome == "failed":
                    raise DeliveryError(error)
        finally:
            for _, stream in files.values():
                stream.close()
        return _Sent([name for name, _ in files.values()])

    def commit(self, messages, batchId: int) -> None:
        self.journal.commit(batchId)

    def abort(self, messages, batchId: int) -> None:
        """The journal stays: what the destination has accepted is not sent again."""


def register_crm_stream(spark: SparkSession, transport: Transport = http_transport, name: str = "crm_stream") -> None:
    """Make ``stream_rows(...).writeStream.format("crm_stream")`` available.

    Options: type, entity, url, token, timeout, batch_size (of lists), and journal, a folder all tasks reach. A failed call fails the
    batch. A list that is confirmed in part is done with: what the answer does not name is not sent again by
    this sink (``CrmSink`` does that). A task that is killed between a call and its line in the journal sends that one call again.
    """

    class CrmStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
            o = self.options
            require_entity(o["type"], o["entity"])
            destination = Destination(o["type"], o["entity"], o["url"], o.get("token", ""), float(o.get("timeout", 30)))
            return _CrmStreamWriter(destination, schema.names, transport, Journal(o["journal"]), int(o.get("batch_size", 250)))

    spark.dataSource.register(CrmStream)
