"""Nearest neighbours by inner product: stable projections, kd-trees, a chi-square stopping test.

With one more component, which fills every vector up to the longest norm, the
largest inner product is the least distance.  ``PROJECTED`` Gaussian projections
keep distances in distribution: a projected squared distance is the true one
times a chi-square variable.  Points are verified on the original vectors in the
order of their projected distance.  The search stops when a point nearer than
the 20th best so far would have shown up already with probability ``CERTAIN``:
that is the chi-square test.

The upper tree is fitted on about ``SAMPLE`` projected points, picked by a hash; it
has a cell for every ``CELL`` vectors (at most one for every eight of the sample) and
cuts the index into groups, which are dealt out in chunks of at most about ``CHUNK``
vectors and as many queries.  A query first searches its own cell; the 20th best
there tells by the same test which other cells it has to visit.  Within a chunk a
smaller kd-tree gives each query a first bound from its nearest leaf, and the
test skips leaves whose box lies beyond it.  All rows are indexed.

Equal vectors are one point with its 21 smallest ids, so copies in any number
make no large group, and nothing is lost: no query needs more of them.

Defined results: null ids and vectors that are null, zero, of another length than
most, or hold null or non-finite components take no part.  Ties go to the
smaller id.  Rows that repeat an id and a vector count once.  An id with several
vectors is a candidate by each of them and asks with all of them: the best hits
of all count, without those of its own id.  A query with fewer candidates gets all;
without usable rows there is no result.  Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealtrail.llm.common import stored

PROJECTED = 32
CERTAIN = 0.95
SAMPLE = 131072
CELL = 4096
CHUNK = 8192
LEAF = 64
PAIRS = 1 << 20  # projected distances held at a time


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(freedom // 2))


def stop_ratio(certain: float = CERTAIN, freedom: int = PROJECTED) -> float:
    """The ratio of squared projected to true distance at which the test holds."""
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < certain else (low, middle)
    return high


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec of the rows that take part, each pair once."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    )
    rows = rows.where(~F.exists("vec", bad)).where(F.exists("vec", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "vec"])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class Tree:
    """A balanced kd-tree over a sample: splits by level, half-open boxes of its cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max((1 << depth) - 1, 0), np.int64)
        self.value = np.zeros(max((1 << depth) - 1, 0))
        cells = 1 << depth
        self.low = np.full((cells, points.shape[1]), -np.inf)
        self.high = np.full((cells, points.shape[1]), np.inf)
        self._split(0, points, 0, cells)

    def _split(self, node: int, points: np.ndarray, first: int, cells: int) -> None:
        if cells == 1:
            return
        axis = int(np.argmax(points.std(0))) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.value[node] = axis, value
        half = cells // 2
        left, right = slice(first, first + half), slice(first + half, first + cells)
        self.high[left, axis] = np.minimum(self.high[left, axis], value)
        self.low[right, axis] = np.maximum(self.low[right, axis], value)
        below = points[:, axis] <= value
        self._split(2 * node + 1, points[below], first, half)
        self._split(2 * node + 2, points[~below], first + half, half)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for a in range(points.shape[1]):
        gap = np.maximum(low[None, :, a] - points[:, None, a], points[:, None, a] - high[None, :, a])
        out += np.maximum(gap, 0) ** 2
    return out


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree, by median splits."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def search(
    ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    query_projected: np.ndarray, floor: np.ndarray, longest: float, top: int, ratio: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best ``top`` of these vectors for each query, at ``floor`` or above.

    Query rows, ids, scores, and how many pairs were verified.
    """
    parts = leaves(projected)
    low = np.stack([projected[p].min(0) for p in parts])
    high = np.stack([projected[p].max(0) for p in parts])
    leaf = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    by_leaf = np.concatenate(parts)
    ids, vectors, projected = ids[by_leaf], vectors[by_leaf], projected[by_leaf]
    lengths = (projected**2).sum(1)
    norms = (queries**2).sum(1)
    slack = 1e-9 * (np.sqrt(norms) * longest + 1e-300)
    best = np.full((len(queries), top), -np.inf)
    bound = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    verified = 0

    def limit(rows: np.ndarray) -> np.ndarray:
        """The projected squared distance at which the test holds."""
        reach = np.where(np.isinf(bound[rows]), np.inf, norms[rows] + longest**2 - 2 * bound[rows])
        return ratio * np.maximum(reach, 0) + 1e-12

    def verify(rows: np.ndarray, points: np.ndarray, wanted: np.ndarray) -> None:
        nonlocal verified
        i, j = np.nonzero(wanted)
        verified += len(i)
        scores = np.full(points.shape, -np.inf)
        scores[i, j] = np.einsum("pd,pd->p", queries[rows[i]], vectors[points[i, j]])
        scores[query_ids[rows][:, None] == ids[points]] = -np.inf
        near = (scores >= (bound[rows] - slack[rows])[:, None]) & (scores > -np.inf)
        scores[~near] = -np.inf
        i, j = np.nonzero(near)
        point = points[i, j]
        found.append((rows[i], ids[point], (queries[rows[i]] * vectors[point]).sum(1)))
        best[rows] = -np.partition(-np.concatenate([best[rows], scores], 1), top - 1, axis=1)[:, :top]
        bound[rows] = np.maximum(bound[rows], best[rows].min(1))

    ends = np.cumsum(np.bincount(leaf))
    away = box_distances(query_projected, low, high)
    nearest_leaf = away.argmin(1)
    by_place = np.argsort(nearest_leaf, kind="stable")
    step = max(1, min(PAIRS // len(ids), 128))
    for rows in np.split(by_place, np.arange(step, len(by_place), step)):
        own = nearest_leaf[rows]
        first = ends[own] - np.bincount(leaf)[own]
        spread = first[:, None] + np.arange(LEAF)
        inside = (spread < ends[own][:, None]) & (away[rows, own] <= limit(rows))[:, None]
        verify(rows, np.minimum(spread, len(ids) - 1), inside)
        near = away[rows] <= limit(rows)[:, None]
        near[np.arange(len(rows)), own] = False
        columns = np.flatnonzero(near.any(0)[leaf])
        if not len(columns):
            continue
        distance = lengths[columns] - 2 * query_projected[rows] @ projected[columns].T
        distance = np.maximum(distance + (query_projected[rows] ** 2).sum(1)[:, None], 0)
        distance[~near[:, leaf[columns]]] = np.inf
        order = np.argsort(distance, axis=1)
        distance = np.take_along_axis(distance, order, 1)
        running, at, width = np.arange(len(rows)), 0, LEAF
        while at < len(columns):
            running = running[distance[running, at] <= np.minimum(limit(rows[running]), np.finfo(float).max)]
            if not len(running):
                break
            part = distance[running, at : at + width]
            wanted = part <= np.minimum(limit(rows[running]), np.finfo(float).max)[:, None]
            verify(rows[running], columns[order[running, at : at + width]], wanted)
            at, width = at + width, min(2 * width, 1024)
    row, vec, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < top], vec[place < top], score[place < top], verified


def nearest(
    vectors: DataFrame, queries: Column, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``queries`` holds, the ``top`` nearest other rows."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lengths[0]["d"]
    rows = stored(rows.where(F.size("vec") == size))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, longest = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    longest *= 1 + 1e-12
    axes = np.random.default_rng(11).standard_normal((size + 1, PROJECTED))
    kind = rows.schema["vec"].dataType.simpleString()
    ratio = stop_ratio()

    def points_of(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1) @ axes

    def projections(batches):
        for batch in batches:
            flat = points_of(_matrix(batch.column(0), size)).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1) * PROJECTED, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat))], ["point"])

    # About SAMPLE rows, by the hash of id and vector; only their projections reach the driver.
    share = math.ceil((1 << 30) * min(1.0, SAMPLE / count))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < share).select("vec")
    sample = _matrix(picked.mapInArrow(projections, "point array<double>").toArrow().column(0), PROJECTED)
    depth = max(0, min(math.ceil(math.log2(max(count / CELL, 1))), int(math.log2(SAMPLE // 8))))
    # toArrow gives rows in no fixed order: medians and spreads are taken over sorted ones.
    tree = Tree(sample[np.lexsort(sample.T)], depth)

    def in_cells(batches):
        for batch in batches:
            cell = tree.cell(points_of(_matrix(batch.column(1), size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "vec", "cell"])

    copies = Window.partitionBy("vec").orderBy("vec_id")
    single = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= top + 1).select("vec_id", "vec")
    index = stored(single.mapInArrow(in_cells, f"vec_id long, vec {kind}, cell long"))
    # One number per cell, at most SAMPLE / 8.
    chunks = {r["cell"]: -(-r["count"] // CHUNK) for r in index.groupBy("cell").count().collect()}
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec")

    def own_cell(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size)
            cell = tree.cell(np.concatenate([x, np.zeros((len(x), 1))], 1) @ axes)
            floor = pa.array(np.full(len(x), -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, floor, pa.array(cell)], ["query_id", "vec", "floor", "cell"])

    def other_cells(batches):
        step = max(1, (PAIRS >> 2) >> tree.depth)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _matrix(batch.column(1), size)
                projected = np.concatenate([x, np.zeros((len(x), 1))], 1) @ axes
                floor = batch.column(2).to_numpy()
                reach = np.where(np.isinf(floor), np.inf, (x**2).sum(1) + longest**2 - 2 * floor)
                near = box_distances(projected, tree.low, tree.high) <= ratio * np.maximum(reach, 0)[:, None] + 1e-12
                near[np.arange(len(x)), tree.cell(projected)] = False
                row, cell = np.nonzero(near)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell)], ["query_id", "vec", "floor", "cell"])

    def found(wanted: DataFrame) -> DataFrame:
        wanted = stored(wanted)
        blocks = {r["cell"]: -(-r["count"] // CHUNK) for r in wanted.groupBy("cell").count().collect()}
        per_cell = [(c, chunks.get(c, 0), blocks[c]) for c in blocks if c in chunks]
        if not per_cell:
            return spark.createDataFrame([], schema)
        sizes = F.broadcast(spark.createDataFrame(per_cell, "cell long, chunks long, blocks long"))
        one_of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = index.join(sizes, "cell").select(
            "cell", one_of("vec_id", "chunks").alias("chunk"), each("blocks").alias("block"), "vec_id", "vec"
        )
        right = wanted.join(sizes, "cell").select(
            "cell", each("chunks").alias("chunk"), one_of("query_id", "blocks").alias("block"), "query_id", "vec", "floor"
        )

        def one(held: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score"]
            if not held.num_rows or not asked.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            x, q = _matrix(held["vec"], size), _matrix(asked["vec"], size)
            query_ids = asked["query_id"].to_numpy()
            row, vec, score, _ = search(
                held["vec_id"].to_numpy(), x, points_of(x), query_ids, q,
                np.concatenate([q, np.zeros((len(q), 1))], 1) @ axes, asked["floor"].to_numpy(), longest, top, ratio,
            )
            return pa.table([pa.array(query_ids[row]), pa.array(vec), pa.array(score)], names=names)

        keys = ["cell", "chunk", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(one, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    first = stored(ranked(found(asked.mapInArrow(own_cell, f"query_id long, vec {kind}, floor double, cell long"))))
    floors = first.where(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
    again = asked.join(floors, "query_id", "left").select(
        "query_id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")
    )
    second = found(again.mapInArrow(other_cells, f"query_id long, vec {kind}, floor double, cell long"))
    return ranked(first.select("query_id", "vec_id", "score").union(second)).select("query_id", "rank", "vec_id", "score")
