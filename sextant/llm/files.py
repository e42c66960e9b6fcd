"""Files that executors write to and read from shared storage."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; ``file://`` and the stores Arrow knows."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def attempt_name(stem: str, ending: str) -> str:
    """A name no other attempt at this task uses.  Only files that a committed
    manifest lists are ever read, so what failed attempts leave does no harm."""
    at = TaskContext.get()
    return f"{stem}-{at.partitionId() if at else 0:06d}-{uuid.uuid4().hex[:12]}{ending}"
