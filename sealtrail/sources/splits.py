"""How a small input is split over cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A table of at most this many splits (about 128 MB each) may be re-split.
MAX_SMALL_SPLITS = 16
# Rows of a task whose rows become much wider than they are stored.
ROWS_PER_TASK = 1 << 16


def spread_small(table: DataFrame) -> DataFrame:
    """Split a stored table over all cores if it was read as a few splits.

    Meant for heavy work per row on a small table, such as one file with one
    row group.  A larger table is left as read, so it is never shuffled here.
    """
    splits = table.rdd.getNumPartitions()
    cores = table.sparkSession.sparkContext.defaultParallelism
    if splits < min(cores, MAX_SMALL_SPLITS):
        return table.repartition(min(cores, 8 * MAX_SMALL_SPLITS))
    return table


def spread_rows(table: DataFrame) -> DataFrame:
    """Split a table of narrow rows so that a task has about ``ROWS_PER_TASK`` of them at most.

    Meant for rows that become far wider than they are stored: the bytes of a split say
    little about them then, and a sort of the wide rows would take memory in proportion to the
    table, as there are about as many splits as cores.  The narrow rows are shuffled for that,
    and counted, which for Parquet files reads their footers alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(min(cores, 8 * MAX_SMALL_SPLITS), -(-table.count() // ROWS_PER_TASK)))
