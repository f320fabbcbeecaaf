"""Disk between steps: new folders, and what becomes of shuffle files."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from sealtrail.operators.ordering import ensure_checkpoint_dir

# Fixed value: Spark's setting that removes a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    for spark, folder in _made:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; what is on this machine can still go
            if folder.startswith(("file:/", "/")):
                shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


@contextmanager
def dropping_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """Shuffle files of each query go when it ends, not when the driver happens to collect its garbage.

    A later job that needs them after all makes them anew.
    """
    before = [(spark, spark.conf.get(_CLEANUP)) for spark in sessions]
    for spark in sessions:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for spark, value in reversed(before):
            spark.conf.set(_CLEANUP, value)


def new_folder(spark: SparkSession, prefix: str = "sealtrail") -> str:
    """A folder's name under ``spark.checkpoint.dir`` that nothing else has."""
    if not _made:
        atexit.register(_remove_all)
    folder = f"{ensure_checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder
