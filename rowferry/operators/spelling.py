"""Names that differ by a few letters, without comparing all pairs.

Short names meet by a neighbourhood of deletions: if two names are at most k edits apart, removing
up to k letters from each leaves a common string. Names of ``LONG`` letters and more, whose neighbourhoods
would be large, meet by pieces: of k + 1 pieces of one name at least one stands unchanged in the other, shifted by at
most k letters. Either way the strings are join keys (hashed, 8 bytes each), candidates are verified, and a key
shared by very many names is cut into cells of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 32
CELL = 1000  # names of one side that meet in one cell of a hot key


def _without_one(name: Column) -> Column:
    size = F.length(name)
    left = F.transform(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, size)),
    )
    return F.when(size > 0, left).otherwise(F.array().cast("array<string>"))


def deletions(name: Column, edits: int) -> Column:
    """The name and all that is left of it after removing up to ``edits`` letters."""
    layer = keys = F.array(name)
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, _without_one)))
        keys = F.concat(keys, layer)
    return keys


def _hashed(tag: Column | str, text: Column) -> Column:
    return F.xxhash64(F.lit(tag) if isinstance(tag, str) else tag, text)


def _piece_start(size: Column, i: Column, edits: int) -> Column:
    return F.floor(size * i / (edits + 1)).cast("int")


def _pieces(name: Column, edits: int) -> Column:
    """Keys of the pieces of a long name, by its length and the piece's number."""
    size = F.length(name)

    def piece(i: Column) -> Column:
        first, end = _piece_start(size, i, edits), _piece_start(size, i + 1, edits)
        return F.xxhash64(size, i, F.substring(name, first + 1, end - first))

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), piece)


def _places(name: Column, edits: int) -> Column:
    """Keys of all that could be a piece of a long name within ``edits``."""
    size, shifts = F.length(name), F.sequence(F.lit(-edits), F.lit(edits))

    def of_piece(other: Column, i: Column) -> Column:
        first, end = _piece_start(other, i, edits), _piece_start(other, i + 1, edits)
        fits = F.filter(shifts, lambda d: (first + d >= 0) & (end + d <= size))
        return F.transform(fits, lambda d: F.xxhash64(other, i, F.substring(name, first + d + 1, end - first)))

    lengths = F.sequence(F.greatest(size - edits, F.lit(LONG)), F.greatest(size + edits, F.lit(LONG)))
    found = F.flatten(
        F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: of_piece(n, i))))
    )
    return F.when(size + edits >= LONG, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def _short(name: Column, edits: int, below: int) -> Column:
    keys = F.transform(deletions(name, edits), lambda k: _hashed("", k))
    return F.when(F.length(name) < below, keys).otherwise(F.array().cast("array<bigint>"))


def near_names(left: DataFrame, right: DataFrame, edits: int = 2, owner: str = "mapping_id") -> DataFrame:
    """(owner, left_name, right_name, distance) of all names of one owner at most ``edits`` apart.

    ``left`` has (owner, left_name), ``right`` (owner, right_name); a name that repeats counts once. Edits are insertions,
    deletions and replacements of one letter, letters are code points. Null and empty names meet nothing,
    nor do rows without an owner.
    """
    if not 0 <= edits < LONG // 2:
        raise ValueError(f"edits must be from 0 to {LONG // 2 - 1}")
    a, b = F.col("left_name"), F.col("right_name")
    # A long left name is cut into pieces; what it meets may be shorter by the edits allowed, or longer.
    keys_a = F.when(F.length(a) < LONG, _short(a, edits, LONG)).otherwise(_pieces(a, edits))
    keys_b = F.concat(_short(b, edits, LONG + edits), _places(b, edits))
    named = (F.col(owner).isNotNull(), a != "", b != "")
    offered = left.where(named[0] & named[1]).select(owner, "left_name").distinct().withColumn("key", F.explode(keys_a))
    wanted = right.where(named[0] & named[2]).select(owner, "right_name").distinct().withColumn("key", F.explode(keys_b))
    sizes = (
        offered.select(owner, "key", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .union(wanted.select(owner, "key", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(owner, "key")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") > CELL) | (F.col("b") > CELL))
        .where((F.col("a") > 0) & (F.col("b") > 0))
    )
    cells = sizes.select(
        owner, "key", F.ceil(F.col("a") / CELL).cast("int").alias("rows"), F.ceil(F.col("b") / CELL).cast("int").alias("columns")
    )

    def in_cells(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """A row goes to one cell of its own direction and to all of the other one; an ordinary key has one cell."""
        cut = side.join(cells, [owner, "key"], "left")
        place = F.coalesce(F.pmod(F.xxhash64(name), F.col(own)), F.lit(0)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return cut.select(owner, "key", name, place.alias(f"_{own}"), every.alias(f"_{other}"))

    met = in_cells(offered, "left_name", "rows", "columns").join(
        in_cells(wanted, "right_name", "columns", "rows"), [owner, "key", "_rows", "_columns"]
    )
    near = met.where(F.abs(F.length(a) - F.length(b)) <= edits).withColumn("distance", F.levenshtein(a, b, edits))
    return near.where("distance >= 0").select(owner, "left_name", "right_name", "distance").distinct()


def suggest_by_edit(
    source_columns: DataFrame, destination_fields: DataFrame, edits: int = 2, owner: str = "mapping_id"
) -> DataFrame:
    """For each destination field the source column spelled most like it, if at most ``edits`` letters differ.

    Inputs: (owner, source_field, pos) and (owner, destination_field). Upper and lower case are the same. Of equally near
    columns the earliest is taken. ``confidence`` is 1 - distance / letters of the longer name, so two edits in
    a short name are a weak proposal. A field nothing is near to has no row.
    """
    # Per spelling only its earliest column can be proposed; min_by combines before the shuffle.
    columns = (
        source_columns.select(owner, F.lower("source_field").alias("left_name"), "source_field", "pos")
        .groupBy(owner, "left_name")
        .agg(F.min(F.struct("pos", "source_field")).alias("column"))
    )
    fields = destination_fields.select(owner, F.lower("destination_field").alias("right_name"), "destination_field").distinct()
    near = near_names(columns, fields, edits, owner).join(columns, [owner, "left_name"])
    best = near.groupBy(owner, "right_name").agg(F.min(F.struct("distance", "column", "left_name")).alias("best"))
    longer = F.greatest(F.length("best.left_name"), F.length("right_name"))
    return fields.join(best, [owner, "right_name"]).select(
        owner,
        F.col("best.column.source_field").alias("source_field"),
        "destination_field",
        F.col("best.distance").alias("distance"),
        (F.lit(1.0) - F.col("best.distance") / longer).alias("confidence"),
    )
