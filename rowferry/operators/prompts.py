"""The text a model is asked to judge, as a table of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text
from .position import row_index
from .selection import BATCH_SIZE

FRAMING = {
    "scoring": "Give each row the probability, 0.0 to 1.0, that it fits the goal.",
    "clustering": "Give 1.0 to rows of the segment the goal describes, 0.0 to rows outside it.",
    "rule_based": "Give 1.0 to rows that satisfy the rule to the letter, 0.0 to all others.",
}
NO_NOTES, NO_ROWS, NO_NAMES = "(none provided)", "(no sample rows available)", "(none)"
# Fixed value: rows of a table shown when a plan is asked for.
PLAN_SAMPLE_ROWS = 20


def described_columns(columns: DataFrame, notes: DataFrame, *table: str) -> DataFrame:
    """One text per table: a line per column, with the user's note where there is one.

    ``columns`` has (…table, ordinal_position, name, data_type), ``notes`` has
    (…table, name, description). A group is the width of one table.
    """
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("data_type"), F.lit(")"),
        F.coalesce(F.concat(F.lit(": "), F.col("description")), F.lit("")),
    )
    return (
        columns.join(notes, [*table, "name"], "left")
        .groupBy(*table)
        .agg(F.sort_array(F.collect_list(F.struct("ordinal_position", line.alias("line")))).alias("l"))
        .select(*table, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("column_lines"))
    )


def plan_prompt(
    df: DataFrame,
    order: list[str],
    *,
    table_name: str,
    goal: str,
    actions: str,
    notes: dict[str, str] | None = None,
    rows: int = PLAN_SAMPLE_ROWS,
) -> DataFrame:
    """One row: the text that asks for a plan, with the columns, the user's notes
    and the first rows of the table in the given order."""
    notes = notes or {}
    lines = "\n".join(
        f"- {f.name} ({f.dataType.simpleString()})" + (f": {notes[f.name]}" if f.name in notes else "")
        for f in df.schema.fields
    )
    head = f"Goal: {goal}\nActions: {actions}\nTable: {table_name}\nColumns:\n{lines}\nStrategies: {', '.join(FRAMING)}\nSample rows:\n"
    first = df.orderBy(*order).limit(rows).select(F.struct(*order).alias("k"), row_json(df).alias("row"))
    sample = F.sort_array(F.collect_list(F.struct("k", "row")))
    text = F.concat(F.lit("["), F.array_join(sample["row"], ","), F.lit("]"))
    return first.agg(F.concat(F.lit(head), F.when(F.size(sample) > 0, text).otherwise(F.lit(NO_ROWS))).alias("prompt"))


def pair_prompts(source_columns: DataFrame, destination_fields: DataFrame, *owner: str) -> DataFrame:
    """(…owner, prompt): the text that asks which column fits which field.

    Both inputs have (…owner, ordinal_position, name, data_type); a group is the
    width of one table.
    """
    none = lambda df: df.select(*owner, "name", F.lit(None).cast("string").alias("description")).limit(0)
    left = described_columns(source_columns, none(source_columns), *owner).withColumnRenamed("column_lines", "_s")
    right = described_columns(destination_fields, none(destination_fields), *owner).withColumnRenamed("column_lines", "_d")
    text = F.concat(
        F.lit("Source columns:\n"), F.col("_s"), F.lit("\nDestination fields:\n"), F.col("_d"),
        F.lit("\nPair the columns with the fields they mean; use each field once at most; leave out what has no match."),
    )
    # An owner that has names on one side only is asked about as well.
    both = left.join(right, list(owner), "full").fillna(NO_NAMES, ["_s", "_d"])
    return both.select(*owner, text.alias("prompt"))


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON; numbers and booleans stay, every other type is given as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = columns or df.columns
    plain = ("tinyint", "smallint", "int", "bigint", "double", "float", "boolean")
    fields = [
        (F.col(c) if types[c].simpleString() in plain else as_text(F.col(c), types[c])).alias(c) for c in chosen
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def prompt_batches(
    df: DataFrame,
    order: list[str],
    *,
    goal: str,
    actions: str,
    selection_rule: str,
    strategy: str = "scoring",
    notes: dict[str, str] | None = None,
    columns: list[str] | None = None,
    batch_size: int = BATCH_SIZE,
    unique: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """(batch, n_rows, keys, prompt): prompts of at most ``batch_size`` rows each.

    Positions come from ``row_index``, so a reply that names local index i of
    batch b always means the same row: ``keys[i]``. ``unique`` and ``partitions``
    are passed to it: say ``unique=False`` if many rows may agree in ``order``.
    """
    notes_text = "\n".join(f"- {c}: {d}" for c, d in (notes or {}).items()) or NO_NOTES
    head = (
        f"Goal: {goal}\nActions: {actions}\nRule: {selection_rule}\n"
        f"Notes:\n{notes_text}\n{FRAMING[strategy]}\nRows:\n"
    )
    slim = df.select(F.struct(*order).alias("key"), *order, row_json(df, columns).alias("row"))
    indexed = row_index(slim, *order, unique=unique, partitions=partitions)
    local = (F.col("row_index") % batch_size).cast("int")
    item = F.concat(F.lit('{"index":'), local.cast("string"), F.lit(',"row":'), F.col("row"), F.lit("}"))
    return (
        indexed.groupBy(F.floor(F.col("row_index") / batch_size).alias("batch"))
        .agg(F.sort_array(F.collect_list(F.struct(local.alias("i"), "key", item.alias("item")))).alias("r"))
        .select(
            "batch",
            F.size("r").alias("n_rows"),
            F.col("r.key").alias("keys"),
            F.concat(F.lit(head), F.lit("["), F.array_join(F.col("r.item"), ","), F.lit("]")).alias("prompt"),
        )
    )
