"""Preset name -> column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import parse_date
from .numbers import to_number
from .text import as_text, strip

_EXPRESSIONS = {
    "lowercase": lambda c, t: F.lower(as_text(c, t)),
    "uppercase": lambda c, t: F.upper(as_text(c, t)),
    "trim": lambda c, t: strip(as_text(c, t)),
    "to_string": as_text,
    "to_number": to_number,
    "parse_date": parse_date,
}


def apply_preset(c: Column, dtype: T.DataType, name: str | None) -> Column:
    """The preset's expression; no name or an unknown one leaves the column alone."""
    expression = _EXPRESSIONS.get(name) if name else None
    return c if expression is None else expression(c, dtype)
