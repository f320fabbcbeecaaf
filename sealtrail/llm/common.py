"""Helpers that several operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sealtrail.sources.scratch import new_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table.

    Workers that see this package's folder may import it from there; elsewhere
    ship the package with the job.
    """
    environment = spark.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), _ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage at a table that survives lost executors; unlike a
    checkpoint it is compressed and later reads take single columns.  The
    folder goes when the driver's process ends.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "llm")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def free_name(rows: DataFrame, wanted: str) -> str:
    """The wanted column name, or a longer one if the input has it already."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and each row's start (one more than rows); null counts as empty."""
    wide = column.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(wide):
        return raw[:0], np.zeros(1, np.int64)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(starts, starts[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
