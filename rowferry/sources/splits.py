"""Splits of about equal row counts for a read that many tasks share.

Equal-width bounds of a partition column give one task most rows where values are uneven. Here the cuts
are quantiles from a sketch, and what lies between them is counted exactly, so a value that is heavier than a split
(or a stretch the sketch could not cut) is seen and cut further by a hash of another column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relations import check_identifier

# Quantiles asked for per split: stretches between them hold about a quarter of a split.
FINENESS = 4

# Part i of n by the hash of a column, null included.
HASHES = {
    "spark": "pmod(xxhash64({column}), {parts}) = {part}",
    "postgres": "mod(abs(cast(hashtext(coalesce(cast({column} AS text), '')) AS bigint)), {parts}) = {part}",
    "clickhouse": "cityHash64(ifNull(toString({column}), '')) % {parts} = {part}",
}
QUOTES = {"spark": "`", "postgres": '"', "clickhouse": "`"}


@dataclass(frozen=True)
class Split:
    """A predicate and its rows: exact, but for parts by hash, whose rows are their share."""

    predicate: str
    rows: int


# A double, a date or a time of the engine, made of its text.
LITERALS = {
    "spark": ("CAST('{}' AS DOUBLE)", "DATE '{}'", "TIMESTAMP '{}'"),
    "postgres": ("CAST('{}' AS DOUBLE PRECISION)", "DATE '{}'", "TIMESTAMP '{}'"),
    "clickhouse": ("toFloat64('{}')", "toDate32('{}')", "toDateTime64('{}', 6)"),
}


def _literal(text: str, kind: T.DataType, dialect: str) -> str:
    double, date, time = LITERALS[dialect]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double.format(text)
    if isinstance(kind, T.DateType):
        return date.format(text)
    return text if isinstance(kind, T.NumericType) else time.format(text)


def _place(column: Column, cuts: list[Column], first: int, last: int) -> Column:
    """2i for values between cut i - 1 and cut i, 2i + 1 for cut i itself, of cuts first to last: a tree of comparisons."""
    if first == last:
        return F.lit(2 * first)
    middle = (first + last) // 2
    cut = cuts[middle]
    return (
        F.when(column < cut, _place(column, cuts, first, middle))
        .when(column == cut, F.lit(2 * middle + 1))
        .otherwise(_place(column, cuts, middle + 1, last))
    )


def _grouped(counts: list[int], capacity: int) -> list[list[int]]:
    """Neighbouring places joined up to the capacity; a place above it is alone."""
    groups, size = [], 0
    for i, n in enumerate(counts):
        if n == 0:
            # Empty now, perhaps not when it is read: goes with its neighbour.
            groups[-1].append(i) if groups else groups.append([i])
        elif groups and size + n <= capacity:
            groups[-1].append(i)
            size += n
        else:
            groups.append([i])
            size = n
    return groups


def _needed(counts: list[int], capacity: int) -> int:
    return sum(max(1, -(-sum(counts[i] for i in g) // capacity)) for g in _grouped(counts, capacity))


def equal_splits(df: DataFrame, column: str, splits: int, spread: str, dialect: str = "spark") -> list[Split]:
    """At most ``splits`` predicates, and more for nulls, that hold every row of ``df`` once each, with about equal rows.

    ``column`` is a number, a date or a timestamp. A value, or the nulls, with more rows than a split is cut by a
    hash of ``spread``, which should be nearly unique. No split has over twice the mean rows as long as it is. A NaN is above all numbers, as in
    Spark and PostgreSQL. Rows that come in later belong to some split as well. Without rows there is one split that holds all.

    Two passes over one column, each of which sends a sketch or a few counts per task; the plan of
    at most 8 * ``splits`` counts is made by the driver. Names of columns are plain identifiers.
    """
    if splits < 1:
        raise ValueError("splits must be 1 or more")
    quote = QUOTES[dialect]
    name, other = (f"{quote}{check_identifier(c)}{quote}" for c in (column, spread))
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{column!r} is neither a number nor a time")
    c = F.col(f"`{column}`")
    shares = [i / (FINENESS * splits) for i in range(1, FINENESS * splits)] or [0.5]
    known = df.where(c.isNotNull() & ~F.isnan(c)) if isinstance(kind, (T.FloatType, T.DoubleType)) else df.where(c.isNotNull())
    sketch = F.percentile_approx(c, shares, max(10_000, 20 * len(shares)))
    # As texts in the session's time zone, in which literals are read as well.
    found = known.agg(sketch.cast("array<string>")).first()[0] or []
    cuts = list(dict.fromkeys(found))
    place = F.when(c.isNull(), F.lit(-1)).otherwise(_place(c, [F.expr(_literal(v, kind, "spark")) for v in cuts], 0, len(cuts)))
    rows = dict(df.groupBy(place.alias("place")).count().collect())
    nulls, counts = rows.get(-1, 0), [rows.get(i, 0) for i in range(2 * len(cuts) + 1)]

    total = sum(counts)
    low, high = max(1, -(-total // splits)), max(1, total)
    while low < high:  # the least capacity that needs no more splits
        capacity = (low + high) // 2
        low, high = (low, capacity) if _needed(counts, capacity) <= splits else (capacity + 1, high)
    out = []

    def add(predicate: str, n: int) -> None:
        parts = max(1, -(-n // low))
        for part in range(parts):
            by_hash = f"{predicate} AND {HASHES[dialect].format(column=other, parts=parts, part=part)}"
            out.append(Split(predicate if parts == 1 else by_hash, n // parts + (part < n % parts)))

    for group in _grouped(counts, low):
        first, last = group[0], group[-1]
        bounds = []
        if first > 0:
            bounds.append(f"{name} {'>=' if first % 2 else '>'} {_literal(cuts[(first - 1) // 2], kind, dialect)}")
        if last < 2 * len(cuts):
            bounds.append(f"{name} {'<=' if last % 2 else '<'} {_literal(cuts[last // 2], kind, dialect)}")
        add(" AND ".join(bounds) or f"{name} IS NOT NULL", sum(counts[i] for i in group))
    add(f"{name} IS NULL", nulls)
    return out


def split_of(splits: list[Split]) -> Column:
    """The numbers of the splits that hold a row: one, as an array, if the splits are sound."""
    return F.array_compact(F.array(*[F.when(F.expr(s.predicate), F.lit(i)) for i, s in enumerate(splits)]))


def read_splits(reader: DataFrameReader, options: dict[str, str], splits: list[Split]) -> DataFrame:
    """A JDBC read with one task per split; ``options`` as of ``jdbc_options`` without a partition column."""
    plain = dict(options)
    url, table = plain.pop("url"), plain.pop("dbtable")
    return reader.jdbc(url, table, predicates=[s.predicate for s in splits], properties=plain)
