"""The date preset: five text layouts to ISO date-time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITESPACE, strip, timestamp_text

ISO_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss"

# Accepted layouts in the order they are tried, each as
# (guard, pattern). The guard holds what the lenient pattern would let by:
# year 0000, three-digit days, trailing text.
_YEAR_FIRST = "(?!0000)[0-9]{4}-[0-9]{1,2}-([0-9]{1,2}| [1-9])"
_TIME = "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
ISO_LAYOUTS = (
    (f"^{_YEAR_FIRST}$", "yyyy-M-d"),
    (f"^{_YEAR_FIRST}[Tt]{_TIME}$", "yyyy-M-d'T'H:m:s"),
    (f"^{_YEAR_FIRST}[{WHITESPACE}]+{_TIME}$", "yyyy-M-d H:m:s"),
)
EUROPEAN_LAYOUTS = (
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.(?!0000)[0-9]{4}$", "d.M.yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/(?!0000)[0-9]{4}$", "d/M/yyyy"),
)


def _plain(t: Column) -> Column:
    """What the pattern can read: a day without padding, one blank, an upper-case T."""
    unpadded = F.regexp_replace(F.upper(t), "^([0-9]{4}-[0-9]{1,2}-) ([1-9])", "$1$2")
    return F.regexp_replace(unpadded, f"[{WHITESPACE}]+", " ")


def parsed_timestamp(text: Column) -> Column:
    """The moment a text names in one of the layouts, else null."""
    t = strip(text)
    # Texts in the usual form are read as they are; only the odd ones (they
    # pass a guard but not the parser) are rewritten first.
    read = lambda p: F.coalesce(F.try_to_timestamp(t, F.lit(p)), F.try_to_timestamp(_plain(t), F.lit(p)))
    iso = [F.when(t.rlike(guard), read(pattern)) for guard, pattern in ISO_LAYOUTS]
    european = [F.when(t.rlike(guard), F.try_to_timestamp(t, F.lit(pattern))) for guard, pattern in EUROPEAN_LAYOUTS]
    # The two families start differently, so no text tries all five guards.
    return F.when(t.rlike("^[0-9]{4}-"), F.coalesce(*iso)).when(t.rlike("^[0-9]{1,2}[./]"), F.coalesce(*european))


def parse_date(c: Column, dtype: T.DataType) -> Column:
    """ISO text of a date in any known layout, else the value as it was."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return F.coalesce(F.date_format(parsed_timestamp(c), ISO_LAYOUT), c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c, dtype, "T")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, ISO_LAYOUT)
    return c
