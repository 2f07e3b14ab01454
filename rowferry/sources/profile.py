"""What a planner needs to know about a relation, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per column: rows, nulls, smallest and largest value.

    Numbers and texts have their own bounds columns. ``distinct`` adds an
    approximate distinct count (a fixed-size sketch per column, so it stays one
    pass with partial aggregation; exact counts would shuffle every value).
    """
    scalar = [f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))]
    measures = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(scalar):
        c = F.col(f"`{f.name}`")
        measures += [F.count(c).alias(f"v{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if distinct:
            measures.append(F.approx_count_distinct(c).alias(f"d{i}"))

    def row(i: int, f: T.StructField):
        number = isinstance(f.dataType, T.NumericType)
        as_number = lambda c: F.col(c).cast("double") if number else F.lit(None).cast("double")
        as_words = lambda c: F.lit(None).cast("string") if number else F.col(c).cast("string")
        fields = [
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"v{i}")).alias("n_null"),
            as_number(f"lo{i}").alias("min_number"),
            as_number(f"hi{i}").alias("max_number"),
            as_words(f"lo{i}").alias("min_text"),
            as_words(f"hi{i}").alias("max_text"),
        ]
        if distinct:
            fields.append(F.col(f"d{i}").alias("approx_distinct"))
        return F.struct(*fields)

    rows = F.array(*[row(i, f) for i, f in enumerate(scalar)])
    return df.agg(*measures).select(F.inline(rows))
