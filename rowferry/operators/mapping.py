"""From source rows to destination-shaped records."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.presets import apply_preset
from ..spec import FieldMap


@dataclass(frozen=True)
class Record:
    """The destination fields of a row: name -> (expression, type).

    Kept as expressions, not as a frame, because a destination may know two
    fields that differ by case only (``ID`` and ``id``).
    """

    fields: dict[str, tuple[Column, T.DataType]]

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def column(self, name: str) -> Column:
        return self.fields[name][0]

    def dtype(self, name: str) -> T.DataType:
        return self.fields[name][1]

    def without_id(self) -> dict[str, tuple[Column, T.DataType]]:
        """All fields but every spelling of ``ID``."""
        return {n: f for n, f in self.fields.items() if n.upper() != "ID"}


def quoted(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(df: DataFrame, mappings: Iterable[FieldMap]) -> Record:
    """Bind a mapping to the columns of ``df``, once, at plan time.

    Items whose source column does not exist are skipped. When two items fill
    one destination field the last one counts, at the place of the first.
    """
    known = {f.name: f.dataType for f in df.schema.fields}
    chosen: dict[str, FieldMap] = {}
    for item in mappings:
        if item.source_field in known:
            chosen[item.destination_field] = item
    exprs = {
        name: apply_preset(quoted(m.source_field), known[m.source_field], m.transformation)
        for name, m in chosen.items()
    }
    bound = df.select(*[c.alias(f"f{i}") for i, c in enumerate(exprs.values())]).schema if exprs else T.StructType()
    return Record({name: (c, bound[i].dataType) for i, (name, c) in enumerate(exprs.items())})


def record_of(df: DataFrame) -> Record:
    """A frame that is already destination-shaped, as a record."""
    return Record({f.name: (quoted(f.name), f.dataType) for f in df.schema.fields})


def apply_mapping(df: DataFrame, mappings: Iterable[FieldMap]) -> DataFrame:
    """One projection: renamed and converted columns, nothing else."""
    record = resolve(df, mappings)
    return df.select(*[c.alias(n) for n, (c, _) in record.fields.items()])
