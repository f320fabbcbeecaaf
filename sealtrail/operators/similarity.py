"""Pairwise cosine similarity within sequences."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sealtrail.operators.ordering import with_dense_index
from sealtrail.schema import HEATMAP_ITEMS

# Ship this module's helpers with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# The largest map; a larger one would build too many cells in one task.
MAX_ITEMS = 1024


def in_blocks(
    items: DataFrame, position: str = "vec_id", size: int = HEATMAP_ITEMS, name: str = "sequence", place: str = "place"
) -> DataFrame:
    """Add each item's dense place in order of ``position``, and the number of its run of ``size`` places.

    Grouped by the run and ordered by the place, every item is in one map, also if positions
    repeat or are null (those come last), and the cells grow with the items.
    """
    rows = items.withColumn("_row", F.monotonically_increasing_id())
    placed, _ = with_dense_index(rows, [F.col(position).asc_nulls_last(), F.col("_row")], place)
    return placed.drop("_row").withColumn(name, F.floor(F.col(place) / F.lit(size)).cast("long"))


def first_items(
    items: DataFrame, group: str, position: str, limit: int = HEATMAP_ITEMS
) -> DataFrame:
    """The first items of each group with their 0-based rank ``i``.

    The rank limit is applied in each task before the shuffle, so a group that
    holds much of the data ships at most ``limit`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(position))
    ranked = items.withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.withColumn("i", F.col("rank") - 1).drop("rank")


def _similarity_map(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.combine_chunks()
    matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    matrix = matrix.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return (matrix @ matrix.T) / (np.outer(norms, norms) + 1e-9)


def _scaled(values: np.ndarray) -> np.ndarray:
    low, high = values.min(), max(0.0, values.max())
    return (values - low) / (high - low + 1e-9)


def _map_cells(
    items: DataFrame, group: str, position: str, vector: str, limit: int,
    finish: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """Cells (group, i, j, value) of each group's similarity map.

    One group is at most ``limit`` vectors when it reaches a task.  The maps
    are matrix products in the task: an array expression over each pair
    measured several times slower already at 64 dimensions.
    """
    if not 0 < limit <= MAX_ITEMS:
        raise ValueError(f"a map has 1 to {MAX_ITEMS} items on a side")
    picked = first_items(items.select(group, position, vector), group, position, limit)
    schema = StructType(
        [
            items.schema[group],
            StructField("i", IntegerType()),
            StructField("j", IntegerType()),
            StructField("value", DoubleType()),
        ]
    )

    def cells(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        values = finish(_similarity_map(rows["vector"]))
        at = np.arange(len(rows), dtype=np.int32)
        labels = pa.repeat(key[0], len(rows) ** 2)
        columns = [labels, np.repeat(at, len(rows)), np.tile(at, len(rows)), values.ravel()]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                        names=[group, "i", "j", "value"])

    return picked.select(group, "i", F.col(vector).alias("vector")).groupBy(group).applyInArrow(
        cells, schema
    )


def cosine_pairs(
    items: DataFrame,
    group: str = "label",
    position: str = "vec_id",
    vector: str = "embedding",
    limit: int = HEATMAP_ITEMS,
) -> DataFrame:
    """All ordered pairs among the first ``limit`` items of each group.

    ``limit`` is the operator's own size, the side of a group's similarity
    map.  Vectors of one group have one length.
    """
    return _map_cells(items, group, position, vector, limit, lambda values: values)


def minmax_scale(
    items: DataFrame,
    group: str = "label",
    position: str = "vec_id",
    vector: str = "embedding",
    limit: int = HEATMAP_ITEMS,
) -> DataFrame:
    """Similarity maps scaled to (v - min) / (max - min + 1e-9).

    The maximum counts from 0 up, so an all-negative map has maximum 0.
    """
    return _map_cells(items, group, position, vector, limit, _scaled)
