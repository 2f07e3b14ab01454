"""Creates and updates, and the payloads a destination expects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import Record

# Fields that hold lists of typed values, and the type given to a plain one.
MULTIFIELDS = ("PHONE", "EMAIL", "WEB", "IM", "LINK")
MULTIFIELD_TYPE = "WORK"

CREATE, UPDATE = "create", "update"

_TEXT = (T.StringType, T.CharType, T.VarcharType)


def _truthy(c: Column, dtype: T.DataType) -> Column:
    """Neither null nor an empty text, zero or false."""
    if isinstance(dtype, _TEXT):
        return c.isNotNull() & (c != "")
    if isinstance(dtype, T.BooleanType):
        return c.isNotNull() & c
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.VariantType):
        text = F.try_variant_get(c, "$", "string")
        number = F.try_variant_get(c, "$", "double")
        is_text = F.schema_of_variant(c) == "STRING"
        return c.isNotNull() & F.when(is_text, text != "").otherwise(F.coalesce(number != 0, F.lit(True)))
    return c.isNotNull()


def _present(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return c.isNotNull() & (F.schema_of_variant(c) != "VOID")
    return c.isNotNull()


def record_id(record: Record) -> Column:
    """The id one record is written under: a truthy ``ID``, else ``id`` as it is.

    Both spellings with different types meet as VARIANT, so the payload keeps
    the type each row came with.
    """
    upper, lower = "ID" in record, "id" in record
    if not upper and not lower:
        return F.lit(None).cast("bigint")
    if not upper:
        return record.column("id")
    chosen = F.when(_truthy(*record.fields["ID"]), record.column("ID"))
    if not lower:
        return chosen
    if record.dtype("ID") == record.dtype("id"):
        return F.coalesce(chosen, record.column("id"))
    return F.coalesce(chosen.cast("variant"), record.column("id").cast("variant"))


def record_op(record: Record) -> Column:
    """create / update of one record: an id that is there, whatever its value, updates."""
    checks = []
    if "ID" in record:
        checks.append(_truthy(*record.fields["ID"]))
    if "id" in record:
        checks.append(_present(*record.fields["id"]))
    condition = F.lit(False)
    for check in checks:
        condition = condition | check
    return F.when(condition, UPDATE).otherwise(CREATE)


def batch_op(record: Record) -> str:
    """create / update where the mere presence of the field decides: known at plan time."""
    return UPDATE if "id" in record else CREATE


def multifield(name: str, c: Column, dtype: T.DataType) -> Column:
    """A plain value of a multi-value field as a one-element list; null and lists stay."""
    if name not in MULTIFIELDS or isinstance(dtype, T.ArrayType):
        return c
    value = F.struct(c.alias("VALUE"), F.lit(MULTIFIELD_TYPE).alias("VALUE_TYPE"))
    return F.when(c.isNotNull(), F.array(value))


def not_json(record: Record) -> Column:
    """True where a field holds NaN or an infinity, which JSON cannot carry."""
    found = F.lit(False)
    for c, dtype in record.fields.values():
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = c.cast("double")
        elif isinstance(dtype, T.VariantType):
            value = F.when(F.schema_of_variant(c) == "DOUBLE", F.try_variant_get(c, "$", "double"))
        else:
            continue
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        found = found | F.coalesce(odd, F.lit(False))
    return found


def _object(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _json(value: Column) -> Column:
    # Nulls are part of the payload: they clear the field at the destination.
    return F.to_json(value, {"ignoreNullFields": "false"})


def record_payload(record: Record) -> Column:
    """``{"id":…,"fields":{…}}`` for an update, ``{"fields":{…}}`` for a create."""
    fields = {n: multifield(n, c, t) for n, (c, t) in record.without_id().items()}
    inner = _json(_object(fields)) if fields else F.lit("{}")
    prefix = F.concat(F.lit('{"id":'), _json_value(record_id(record)), F.lit(',"fields":'))
    return F.concat(F.when(record_op(record) == UPDATE, prefix).otherwise(F.lit('{"fields":')), inner, F.lit("}"))


def _json_value(c: Column) -> Column:
    """JSON text of one value (to_json only writes objects and arrays)."""
    wrapped = _json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def record_calls(df: DataFrame, record: Record, entity: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One call per record: (…keep, op, method, payload, unsendable)."""
    op = record_op(record)
    method = F.concat(
        F.lit(f"crm.{entity}."), F.when(op == UPDATE, "update").otherwise("add")
    )
    return df.select(
        *keep,
        op.alias("op"),
        method.alias("method"),
        record_payload(record).alias("payload"),
        not_json(record).alias("unsendable"),
    )


def batch_items(df: DataFrame, record: Record, keep: tuple[str, ...] = ()) -> DataFrame:
    """One item per record for a destination that takes lists: (…keep, op, item, unsendable)."""
    item = _json(_object({n: c for n, (c, _) in record.fields.items()})) if record.fields else F.lit("{}")
    return df.select(*keep, F.lit(batch_op(record)).alias("op"), item.alias("item"), not_json(record).alias("unsendable"))


def batch_payloads(items: DataFrame, batch_size: int, key: str | None = None) -> DataFrame:
    """Lists of at most ``batch_size`` items as (op, n, payload, unsendable, call_keys).

    Batches are cut inside each partition while the rows stream by, so there
    is no shuffle and a task holds one open batch per op; a grouping on a batch
    number would move every payload over the network to build the same lists.
    A list is unsendable if one of its items is. ``call_keys`` holds the key
    column of the items, if one is named.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    names = ["op", "n", "payload", "unsendable", "call_keys"]

    def close(op: str, batch: list[tuple]) -> tuple:
        payload = f"[{','.join(item for item, _, _ in batch)}]"
        return op, len(batch), payload, any(odd for _, odd, _ in batch), [k for _, _, k in batch]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_batches: dict[str, list[tuple]] = {}
        for frame in frames:
            done = []
            for op, *item in frame.itertuples(index=False, name=None):
                batch = open_batches.setdefault(op, [])
                batch.append(item)
                if len(batch) == batch_size:
                    done.append(close(op, open_batches.pop(op)))
            if done:
                yield pd.DataFrame(done, columns=names)
        rest = [close(op, batch) for op, batch in open_batches.items()]
        if rest:
            yield pd.DataFrame(rest, columns=names)

    keys = F.col(key) if key else F.lit(None).cast("string")
    return items.select("op", "item", "unsendable", keys.alias("key")).mapInPandas(
        cut, "op string, n int, payload string, unsendable boolean, call_keys array<string>"
    )


def collapse(df: DataFrame, id_column: str, *order: str) -> DataFrame:
    """The last version of each id; rows without an id are all kept.

    "Last" is the greatest ``order`` tuple. ``max_by`` combines on the map side, so
    an id with a third of all rows still arrives as one row per map task.
    """
    others = [c for c in df.columns if c != id_column]
    latest = (
        df.where(F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
        .select(id_column, "r.*")
        .select(*df.columns)
    )
    return latest.unionByName(df.where(F.col(id_column).isNull()))


def idempotency_key(owner: str, columns: list[Column]) -> Column:
    """A stable name for one create, so that a repeated send can be recognised."""
    return F.sha2(F.to_json(F.struct(F.lit(owner).alias("o"), *[c.alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def written_counts(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records written, skipped as not found and failed, from a sender's results.

    ``results`` has (outcome, items): items is what the call wrote, 1 for a
    single record or the number of records echoed back for a batch, which may
    be fewer than were sent (outcome ``partial``).
    """
    return results.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("outcome").isin("written", "partial"), F.col("items"))), F.lit(0)).cast("bigint").alias("written"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
