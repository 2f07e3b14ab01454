"""Files that tasks and the driver reach by the path Spark uses."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a local path or a URI."""
    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return fs.LocalFileSystem(), path
