"""The ledger root: an order-dependent Merkle Mountain Range.

Leaves ``[start, end)`` split into aligned perfect trees.  Which tree a leaf
belongs to follows from the bits of its index alone, so every tree is folded at
once: leaves are grouped by aligned blocks of 1,024 and each block becomes one
node, then nodes are grouped again.  A block whose leaves lie in one partition
is folded there; as partitions are contiguous, only the leaves at their edges are
shuffled.  One shuffle serves ten levels, no group is larger than a block, and
only the last few dozen nodes reach the driver.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail.functions.hashing import merkle_parent
from sealtrail.operators.ordering import with_dense_index
from sealtrail.schema import EMPTY_ROOT, LEDGER_ORDER

# Ship this module's helpers with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_LEVELS = 10


def _parent(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + left.encode() + right.encode()).hexdigest()


@dataclass(frozen=True)
class MountainRange:
    """Leaf count and peaks, largest first; heights are the count's set bits."""

    leaf_count: int = 0
    peaks: tuple[str, ...] = ()

    @property
    def root(self) -> str:
        if not self.peaks:
            return EMPTY_ROOT
        *rest, bagged = self.peaks
        for peak in reversed(rest):
            bagged = _parent(peak, bagged)
        return bagged

    def extended(self, trees: list[tuple[int, str]], blocks: dict[int, str] | None = None) -> MountainRange:
        """Add (height, root) of the perfect trees that follow, in order.

        ``blocks`` takes the nodes of whole blocks that come about by merging, by block number.
        """
        count = self.leaf_count
        bits = [h for h in range(count.bit_length() - 1, -1, -1) if count >> h & 1]
        stack = list(zip(bits, self.peaks))
        for height, node in trees:
            count += 1 << height
            while stack and stack[-1][0] == height:
                node = _parent(stack.pop()[1], node)
                height += 1
                if blocks is not None and height == BLOCK_LEVELS:
                    blocks[(count - 1) >> BLOCK_LEVELS] = node
            stack.append((height, node))
        return MountainRange(count, tuple(node for _, node in stack))


def _shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _highest_bit(value: Column) -> Column:
    return F.length(F.bin(value)) - 1


def _fold_block(hashes: Column, levels: Column) -> Column:
    """Root of one perfect tree from its 2^levels nodes in order."""

    def halve(nodes: Column, _: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(nodes), 1) - 1),
            lambda i: merkle_parent(nodes[i * 2], nodes[i * 2 + 1]),
        )

    folded = F.aggregate(F.sequence(F.lit(1), levels), hashes, halve)
    return F.when(levels == 0, hashes[0]).otherwise(folded[0])


def perfect_trees(
    indexed: DataFrame,
    start: int,
    end: int,
    index: str = "leaf_index",
    leaf: str = "leaf_hash",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> list[tuple[int, str]]:
    """(height, root) of the aligned perfect trees covering ``[start, end)``.

    ``keep`` gets the nodes after the first ten levels, those of whole blocks and of
    smaller trees, and returns them to be folded on, for example stored.

    ``indexed`` has every index in the range once.  The largest aligned tree
    around a leaf ends below the highest bit in which its index differs from
    ``end`` and from ``start - 1``.
    """
    if start >= end:
        return []
    at = F.col(index)
    height = _highest_bit(at.bitwiseXOR(F.lit(end)))
    if start:
        height = F.least(height, _highest_bit(at.bitwiseXOR(F.lit(start - 1))))
    nodes = indexed.select(
        height.cast("int").alias("height"), at.alias("pos"), F.col(leaf).alias("node")
    )
    tallest = (end - start).bit_length() - 1
    nodes = nodes.mapInArrow(_fold_whole_blocks, "height int, pos long, node string, folded boolean")
    for done in range(0, max(tallest, 1), BLOCK_LEVELS):
        nodes = _fold_levels(nodes, done)
        if keep is not None and not done:
            nodes = keep(nodes)
    rows = nodes.select(_shift_left(F.col("pos"), F.col("height")).alias("first"), "height", "node")
    return [(r.height, r.node) for r in sorted(rows.collect())]


def _fold_whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the blocks whose leaves are all in this partition; the other leaves pass.

    Rows come as (height, pos, node), nearly always in the order of ``pos``, so one
    open block is held at a time.
    """
    size = 1 << BLOCK_LEVELS
    open_: dict[int, list[tuple[int, str, int]]] = {}

    def made(rows: list[tuple[int, int, str, bool]]) -> pa.RecordBatch:
        height, pos, node, folded = zip(*rows) if rows else ((), (), (), ())
        arrays = [
            pa.array(height, pa.int32()), pa.array(pos, pa.int64()), pa.array(node, pa.string()), pa.array(folded, pa.bool_())
        ]
        return pa.RecordBatch.from_arrays(arrays, ["height", "pos", "node", "folded"])

    for batch in batches:
        out: list[tuple[int, int, str, bool]] = []
        for height, pos, node in zip(*(c.to_pylist() for c in batch.columns)):
            if height < BLOCK_LEVELS:
                out.append((height, pos, node, False))
                continue
            block = open_.setdefault(pos >> BLOCK_LEVELS, [])
            block.append((pos, node, height))
            if len(block) == size and len({p for p, _, _ in block}) == size:
                nodes = [n for _, n, _ in sorted(open_.pop(pos >> BLOCK_LEVELS))]
                while len(nodes) > 1:
                    nodes = [_parent(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
                out.append((height, pos >> BLOCK_LEVELS, nodes[0], True))
        yield made(out)
    yield made([(height, pos, node, False) for block in open_.values() for pos, node, height in block])


def _fold_levels(nodes: DataFrame, done: int) -> DataFrame:
    """Fold ten levels; nodes that are folded already pass."""
    levels = F.greatest(F.lit(0), F.least(F.lit(BLOCK_LEVELS), F.col("height") - done))
    levels = F.when(F.col("folded"), F.lit(0)).otherwise(levels)
    members = F.sort_array("members")
    complete = F.when(
        F.size("members") == _shift_left(F.lit(1), F.col("levels")), members["node"]
    ).otherwise(F.raise_error(F.lit("leaf positions are not dense")))
    return (
        nodes.withColumn("levels", levels)
        .groupBy("height", "levels", "folded", _shift_right(F.col("pos"), F.col("levels")).alias("block"))
        .agg(F.collect_list(F.struct("pos", "node")).alias("members"))
        .select(
            "height",
            F.col("block").alias("pos"),
            _fold_block(complete, F.col("levels")).alias("node"),
            F.lit(False).alias("folded"),
        )
    )


def mountain_range(
    leaves: DataFrame, order: tuple[str, ...] = LEDGER_ORDER, leaf: str = "leaf_hash"
) -> MountainRange:
    """Range over all rows, in ledger order."""
    indexed, count = with_dense_index(leaves.select(*order, leaf), list(order))
    return MountainRange().extended(perfect_trees(indexed, 0, count, leaf=leaf))


def ledger_root(ledger: DataFrame) -> DataFrame:
    """One row: leaf_count, merkle_root."""
    summary = mountain_range(ledger)
    return ledger.sparkSession.createDataFrame(
        [(summary.leaf_count, summary.root)], "leaf_count long, merkle_root string"
    )


def leaf_index(ledger: DataFrame, order: tuple[str, ...] = LEDGER_ORDER) -> DataFrame:
    """The ledger with each row's 0-based position in ledger order."""
    return with_dense_index(ledger, list(order))[0]
