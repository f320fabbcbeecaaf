"""Folders of a stored table: which are there, and which small ones to merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

# The newest runs are merged when there are as many.
FAN = 8
# Fixed value: hashes as hexadecimal text take twice their size under a codec without entropy coding.
CODEC = "zstd"


def merge_from(sizes: Sequence[int]) -> int | None:
    """The first of the newest runs that are merged into one now, or None.

    A run is taken along if it is not larger than all that follow it.  So a row is
    rewritten each time its run has at least doubled, and of the runs left alone each is
    larger than all that follow: there are at most ``FAN`` for each doubling of the table.
    """
    start, after = len(sizes), 0
    while start and (start == len(sizes) or sizes[start - 1] <= after):
        start -= 1
        after += sizes[start]
    return start if len(sizes) - start >= FAN else None


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    files, path = _path(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.delete(path, True)
