"""Polling as a streaming source: rows whose (field value, key) is beyond the last poll.

The offset is the greatest (value, key) a poll has seen, kept in the stream's checkpoint, so rows that
share the last value of a poll are told apart by their key: none is read twice, none is left out. A poll
reads statistics only; the rows between two offsets are planned as splits and read by the
tasks. A batch that is replayed reads the same range again.

``ParquetTable`` polls a folder of parquet files. Another relation is a class with the same
three methods (for a database: newest is one ORDER BY ... LIMIT 1, a split a predicate).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..files import file_system

Mark = tuple  # (value, key): numbers or texts

SPLIT_ROWS = 1_000_000


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.ChunkedArray | pa.Array:
    """A column as numbers or texts that offsets can hold and that compare alike."""
    kind = column.type
    if pa.types.is_timestamp(kind):
        return column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64())
    if pa.types.is_date(kind):
        return column.cast(pa.date32()).cast(pa.int32()).cast(pa.int64())
    if pa.types.is_integer(kind):
        return column.cast(pa.int64())
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.cast(pa.string())
    raise ValueError(f"a stream can't be polled by a column of type {kind}")


def _plain_value(value) -> int | str:
    if isinstance(value, dt.datetime):
        zone = value.tzinfo or dt.timezone.utc
        return (value.replace(tzinfo=zone) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days
    return value


@dataclass(frozen=True)
class Split:
    """Row groups of files that hold rows between two marks."""

    groups: tuple[tuple[str, tuple[int, ...]], ...]
    after: Mark | None
    upto: Mark


class ParquetTable:
    """A folder of parquet files that grows by further files.

    ``value`` is the polled field (time, date, whole number or text), ``key`` identifies rows of one value. Rows without a
    value are never polled; without a key they count as the smallest of their value. A row that
    comes in later with a mark before the last poll's is not seen, as with any polling.
    """

    def __init__(self, path: str, value: str, key: str, split_rows: int = SPLIT_ROWS):
        self.path, self.value, self.key, self.split_rows = path, value, key, split_rows

    def _groups(self) -> Iterator[tuple[str, int, int, object, object]]:
        """(file, row group, rows, least value, greatest value); None where there are no statistics."""
        system, path = file_system(self.path)
        try:
            files = sorted(ds.dataset(path, filesystem=system, format="parquet").files)
        except FileNotFoundError:
            return
        for file in files:
            facts = pq.read_metadata(file, filesystem=system)
            names = [facts.schema.column(i).path for i in range(facts.num_columns)]
            column = names.index(self.value) if self.value in names else None
            for group in range(facts.num_row_groups):
                row_group = facts.row_group(group)
                told = row_group.column(column).statistics if column is not None else None
                if told is not None and told.has_min_max:
                    yield file, group, row_group.num_rows, _plain_value(told.min), _plain_value(told.max)
                elif row_group.num_rows:
                    yield file, group, row_group.num_rows, None, None

    def newest(self) -> Mark | None:
        """The greatest (value, key): the row groups that hold the greatest value are read for the keys, two columns of them."""
        groups, (system, _) = list(self._groups()), file_system(self.path)
        known = [high for *_, high in groups if high is not None]
        best: Mark | None = None
        for file, group, _, _, high in groups:
            if high is not None and high < max(known):
                continue
            rows = pq.ParquetFile(file, filesystem=system).read_row_group(group, columns=[self.value, self.key])
            values, keys = _plain(rows[self.value]), _plain(rows[self.key])
            top = pc.max(values).as_py()
            if top is None:
                continue
            last = pc.max(keys.filter(pc.fill_null(pc.equal(values, top), False))).as_py()
            if best is None or _before(best, (top, last)):
                best = (top, last)
        return best

    def splits(self, after: Mark | None, upto: Mark) -> list[Split]:
        """The row groups that may hold rows in (after, upto], dealt by their rows."""
        parts, open_, rows = [], {}, 0
        for file, group, count, low, high in self._groups():
            if low is not None and (low > upto[0] or (after is not None and high < after[0])):
                continue
            if open_ and rows + count > self.split_rows:
                parts.append(open_)
                open_, rows = {}, 0
            open_.setdefault(file, []).append(group)
            rows += count
        parts += [open_] if open_ else []
        return [Split(tuple((file, tuple(groups)) for file, groups in part.items()), after, upto) for part in parts]

    def read(self, split: Split, columns: list[str]) -> Iterator[pa.RecordBatch]:
        wanted = list(dict.fromkeys([*columns, self.value, self.key]))
        system, _ = file_system(self.path)
        for file, groups in split.groups:
            for batch in pq.ParquetFile(file, filesystem=system).iter_batches(row_groups=list(groups), columns=wanted):
                values = _plain(batch.column(wanted.index(self.value)))
                keys = _plain(batch.column(wanted.index(self.key)))
                keep = _upto(values, keys, split.upto)
                if split.after is not None:
                    keep = pc.and_(keep, pc.invert(_upto(values, keys, split.after)))
                batch = batch.filter(pc.fill_null(keep, False))
                if batch.num_rows:
                    yield batch.select(columns)


def _before(a: Mark, b: Mark) -> bool:
    if a[0] != b[0]:
        return a[0] < b[0]
    return b[1] is not None and (a[1] is None or a[1] < b[1])


def _upto(values: pa.Array, keys: pa.Array, mark: Mark) -> pa.Array:
    """Whether rows lie at or before a mark; null for rows without a value."""
    same = pc.is_null(keys) if mark[1] is None else pc.fill_null(pc.less_equal(keys, mark[1]), True)
    return pc.or_(pc.less(values, mark[0]), pc.and_(pc.equal(values, mark[0]), same))


class _Planned(InputPartition):
    def __init__(self, split):
        self.split = split


class _Reader(DataSourceStreamReader):
    def __init__(self, relation, schema: StructType):
        self.relation, self.names = relation, schema.names
        self.arrow = to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = self.relation.newest()
        return {} if found is None else {"value": found[0], "key": found[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end or not end:
            return []
        after = (start["value"], start["key"]) if start else None
        return [_Planned(split) for split in self.relation.splits(after, (end["value"], end["key"]))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in self.relation.read(partition.split, self.names):
            yield batch.cast(self.arrow)


def polled(spark: SparkSession, relation, schema: StructType | str, name: str = "polled") -> DataFrame:
    """What is new in ``relation`` at every poll, as a stream of rows of ``schema``.

    A stream with ``trigger(availableNow=True)`` polls once; started again with the same checkpoint
    it goes on from there. ``name`` is the format's name in the session.
    """
    fields = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return fields

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Reader(relation, schema)

    spark.dataSource.register(Polled)
    return spark.readStream.format(name).load()
