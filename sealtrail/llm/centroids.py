"""Centroid clustering of vectors over a vector-approximation file.

Every vector is stored once in full, as whole numbers, and once as an approximation:
the number of its cell in each dimension, of ``2 ** bits`` equal cells between the
dimension's ends.  A round reads the approximations.  A table per centroid, dimension
and cell gives the least and the largest that the dimension adds to the distance,
so each centroid's distance is known to an interval.  What is tabled is the distance
less that to the mean of all centroids, which is the same for every centroid and leaves
the comparison as it is, but makes the intervals several times narrower.

Full vectors are fetched, by a join on their number, where intervals overlap or where
a vector changes its cluster: only those change a cluster's sum.  The first round and
the last assignment need all of them.  The fetch list is stored first, so its real size
decides whether it is broadcast.  The driver holds the centroids and a sum per
centroid and dimension.

Defined results: vectors null, of another length, or with a null or non-finite component are
left out.  Fewer kept vectors than centroids make that many centroids, none an empty
table.  Repeated rows count each.  Null ids have no hash and start a centroid only if too
few others do; equal hashes start in order of their vectors.  A component whose
whole number is beyond 2 ** 27 is an error, as distances would not fit into a long.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.common import stored

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
# A cell's number takes a byte.
BITS = 8
LARGEST = 1 << 27

OUTPUT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id, vector: kept vectors as whole numbers."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), parts.alias("_x")).where(F.size("_x") == dimensions)
    return kept.where(~odd).select("vec_id", F.transform("_x", lambda x: F.floor(x * scale)).alias("vector"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def numbered(rows: DataFrame, dimensions: int) -> DataFrame:
    """Add ``_row``, a number of the stored row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            values = matrix(batch.column(1), dimensions)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST}")
            flat = pa.array(values.astype(np.int32).ravel())
            starts = pa.array(np.arange(len(values) + 1, dtype=np.int32) * dimensions)
            count = pa.array(np.arange(at, at + len(values)))
            at += len(values)
            whole = pa.ListArray.from_arrays(starts, flat)
            yield pa.RecordBatch.from_arrays([count, batch.column(0), whole], ["_row", "vec_id", "vector"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, vec_id {kind}, vector array<int>")


def ends(rows: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(0), dimensions)
                columns = [np.arange(dimensions, dtype=np.int32), values.min(0), values.max(0)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["at", "low", "high"])

    found = rows.select("vector").mapInArrow(run, "at int, low long, high long")
    found = found.groupBy("at").agg(F.min("low"), F.max("high")).orderBy("at").collect()
    low, high = (np.array([r[i] for r in found], np.int64) for i in (1, 2))
    return low, high


class Grid:
    """The cells of each dimension; ``edges[d, c]`` is the least whole number in a cell."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        if not 1 <= bits <= 8:
            raise ValueError("a cell's number has 1 to 8 bits")
        cells = 1 << bits
        steps = np.arange(cells + 1, dtype=np.int64)
        self.low, self.cells = low, cells
        self.width = high - low + 1
        self.edges = low[:, None] + -(-self.width[:, None] * steps // cells)

    def cell(self, values: np.ndarray) -> np.ndarray:
        return ((values - self.low) * self.cells // self.width).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """[dimension, cell, 2 * centroids]: least and largest part of the shifted distance.

        A part is linear in the component, so its ends are at the cell's ends.
        """
        mean = centroids.sum(0) // len(centroids)
        first, last = self.edges[:, :-1], np.maximum(self.edges[:, 1:] - 1, self.edges[:, :-1])
        at_first, at_last = (
            np.stack([(x - c[:, None]) ** 2 - (x - mean[:, None]) ** 2 for c in centroids], -1) for x in (first, last)
        )
        return np.concatenate([np.minimum(at_first, at_last), np.maximum(at_first, at_last)], -1)


def decided(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Nearest centroid by intervals alone, -1 where they overlap."""
    sums = np.zeros((len(cells), tables.shape[2]), np.int64)
    for d in range(cells.shape[1]):
        sums += tables[d][cells[:, d]]
    k = sums.shape[1] // 2
    least, most = sums[:, :k], sums[:, k:]
    best = most.argmin(1)
    bound = most[np.arange(len(cells)), best]
    # At equal distance the smaller number wins.
    open_ = (least < bound[:, None]) | ((least == bound[:, None]) & (np.arange(k) < best[:, None]))
    open_[np.arange(len(cells)), best] = False
    return np.where(open_.any(1), -1, best)


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((values - c) ** 2).sum(1) for c in centroids], 1)


def approximations(full: DataFrame, grid: Grid) -> DataFrame:
    """_row and cells: one byte per dimension."""
    dimensions = len(grid.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = grid.cell(matrix(batch.column(1), dimensions)).tobytes()
            starts = np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions
            cells = pa.BinaryArray.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(raw)]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], ["_row", "cells"])

    return full.select("_row", "vector").mapInArrow(run, "_row long, cells binary")


def to_fetch(cells: DataFrame, grid: Grid, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """Numbers of the vectors that may change cluster between two sets of centroids."""
    dimensions, tables = len(grid.low), (grid.tables(before), grid.tables(now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[start : start + len(column) * dimensions]
            old, new = (decided(raw.reshape(-1, dimensions), t) for t in tables)
            rows = batch.column(0).filter(pa.array((old < 0) | (new < 0) | (old != new)))
            yield pa.RecordBatch.from_arrays([rows], ["_row"])

    return cells.mapInArrow(run, "_row long")


def sums(rows: DataFrame, before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors add to each cluster's sum and count when going from one set of centroids to another."""
    k, dimensions = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            values = matrix(batch.column(0), dimensions)
            counted = np.concatenate([values, np.ones((len(values), 1), np.int64)], 1)
            new = distances(values, now).argmin(1)
            np.add.at(total, new, counted)
            if before is not None:
                np.subtract.at(total, distances(values, before).argmin(1), counted)
        at, cluster = np.meshgrid(np.arange(dimensions + 1, dtype=np.int32), np.arange(k, dtype=np.int32))
        columns = [cluster.ravel(), at.ravel(), total.ravel()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cluster", "at", "part"])

    parts = rows.select("vector").mapInArrow(run, "cluster int, at int, part long")
    total = np.zeros((k, dimensions + 1), np.int64)
    for r in parts.groupBy("cluster", "at").agg(F.sum("part").alias("part")).collect():
        total[r.cluster, r.at] = r.part
    return total[:, :-1], total[:, -1]


def fit(full: DataFrame, start: np.ndarray, rounds: int, bits: int, shares: list | None = None) -> np.ndarray:
    """Centroids after the rounds.

    ``shares`` takes the number of fetched vectors of each round that reads approximations.
    """
    dimensions = start.shape[1]
    if not rounds:
        return start
    grid = Grid(*ends(full, dimensions), bits)
    cells = stored(approximations(full, grid))
    before, now = None, start
    total, count = sums(full, None, start)
    for number in range(rounds):
        if number:
            wanted = stored(to_fetch(cells, grid, before, now))
            if shares is not None:
                shares.append(wanted.count())
            more, moved = sums(full.join(wanted, "_row"), before, now)
            total, count = total + more, count + moved
        before = now
        now = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], now)
        if (now == before).all():
            break  # every further round would give the same
    return now


def cluster(
    vectors: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    bits: int = BITS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    full = stored(numbered(whole_vectors(vectors, vec_id, vector, dimensions, scale), dimensions))
    spark, kind = full.sparkSession, full.schema["vec_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = full.orderBy(key.asc_nulls_last(), "vector").limit(centroids).select("vector").collect()
    if not picked:
        return spark.createDataFrame([], f"vec_id {kind}, {OUTPUT}")
    final = fit(full, np.array([r.vector for r in picked], np.int64), rounds, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column(1), dimensions), final)
            columns = [batch.column(0), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    placed = stored(full.select("vec_id", "vector").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    inertia = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    each = [(c, inertia[c], sum(inertia.values()), shown[c]) for c in sorted(inertia)]
    # One row per centroid.
    table = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", *[c.split()[0] for c in OUTPUT.split(", ")])
