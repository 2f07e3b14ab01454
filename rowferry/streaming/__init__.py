"""The same runs over a stream."""

from .activation import VersionLog, deduplicate, stream_sync
from .polling import ParquetTable, polled
from .versions import newest_versions
from .windows import accounted, closed_until, run_windows, streaks

__all__ = [
    "ParquetTable",
    "VersionLog",
    "accounted",
    "closed_until",
    "deduplicate",
    "newest_versions",
    "polled",
    "run_windows",
    "streaks",
    "stream_sync",
]
