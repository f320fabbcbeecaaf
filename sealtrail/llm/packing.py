"""Best-fit packing with large-item matching, planned on the histogram of lengths.

A plan depends on how many pieces have each length, not on which they are.  So
Spark counts lengths, the driver plans on at most ``capacity`` counts, and the
plan's groups of equal bins are dealt to the pieces by their rank within a
length.  Counts and plan are bounded by the capacity alone, whatever the input.

Large pieces, above a third of the capacity, meet at most twice in a bin: the
longest left takes the longest that still fits.  Smaller pieces, longest first,
go where they leave the least room; new bins open when none has room.  Only
documents longer than the capacity are cut, and just their first piece is not
full, so only one piece per document needs a partner.

Defined results: a null or empty text is one end token.  No documents give no
rows.  Repeated rows are packed each; their ids tell them apart no more than
in the input.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealtrail.llm.bpe import load
from sealtrail.llm.common import stored

CAPACITY = 2048
END = 0


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first bin, offset).

    The pieces of a length with ranks first, first + 1, ... go to the bins
    first bin, first bin + 1, ..., all at the same offset.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first bin, how many)
    bins = 0

    def put(length: int, many: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], many, first_bin, offset))
        used[length] += many
        left[length] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for partner in large:
            if not left[length]:
                break
            if partner > length or length + partner > capacity or not left[partner]:
                continue
            many = left[length] // 2 if partner == length else min(left[length], left[partner])
            if many:
                put(length, many, bins, 0)
                put(partner, many, bins, length)
                rooms[capacity - length - partner].append((bins, many))
                bins += many
        if left[length]:
            many = left[length]
            put(length, many, bins, 0)
            rooms[capacity - length].append((bins, many))
            bins += many
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for room in range(length, capacity + 1):
            while left[length] and rooms.get(room):
                first, many = rooms[room].pop()
                taken = min(many, left[length])
                put(length, taken, first, capacity - room)
                rooms[room - length].append((first, taken))
                if taken < many:
                    rooms[room].append((first + taken, many - taken))
            if not left[length]:
                break
        each = capacity // length
        while left[length]:
            many, deep = (left[length] // each, each) if left[length] >= each else (1, left[length])
            for k in range(deep):
                put(length, many, bins, k * length)
            rooms[capacity - deep * length].append((bins, many))
            bins += many
    return runs


def cut(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str, text: str) -> DataFrame:
    """One row per piece; ``_slot`` is its place among those of its length in the task ``_part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = load(vocabulary, library=True), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows, piece, start, length, crc, slot = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = bpe.encode(value.as_py()) + END.to_bytes(4, "little")
                size = len(ids) // 4
                first = size % capacity or capacity
                for number, end in enumerate(range(first, size + 1, capacity)):
                    begin = end - capacity if number else 0
                    rows.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(ids[4 * begin : 4 * end]))
                    slot.append(seen[end - begin])
                    seen[end - begin] += 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, slot)]
            columns += [pa.array(piece, pa.int32()), pa.array([part] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "start", "length", "ids_crc32", "_slot", "piece", "_part"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, _slot long, piece int, _part int"
    )


def ranked(pieces: DataFrame) -> DataFrame:
    """Add ``_rank``, dense among the pieces of a length: the counts of earlier tasks plus the slot.

    What is summed has one row per length and task, and a group one per task.
    """
    order = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("length", "_part").count().select(
        "length", "_part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("_before")
    )
    return pieces.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_slot"))


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut(docs, vocabulary, capacity, doc_id, text))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    # Bounded by the capacity: a run for each length and room at most.
    shared = docs.sparkSession.sparkContext.broadcast(table)
    wide = int(table[:, 1].max(initial=0) + table[:, 2].max(initial=0)) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] * wide + runs[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(6).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            columns = [
                *(batch.column(i) for i in range(5)),
                pa.array(runs[at, 3] + rank - runs[at, 1], pa.int64()),
                pa.array(runs[at, 4], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return (
        ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "_slot", "_rank")
        .mapInArrow(
            place,
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
