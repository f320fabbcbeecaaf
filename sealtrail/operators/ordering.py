"""Dense positions in a total order, without a single-task window."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# monotonically_increasing_id() is partition number << 33 plus the row's
# position in its partition.
_SLOT_BITS = 33


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sealtrail-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def with_dense_index(
    df: DataFrame, order: list[Column | str], name: str = "leaf_index", ends: list | None = None
) -> tuple[DataFrame, int]:
    """Add each row's 0-based position in ``order``; also return the row count.

    ``ends``, a list, takes the first and last row's values of ``order``, named columns then.

    The order has to be total.  One range shuffle sorts the rows, so rows that
    share the leading key are split by the next one.  The sorted rows are
    checkpointed, which fixes partition contents; each row then adds its place
    in its partition to the partition's start.  Only one number per partition
    passes through the driver.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    columns = df.columns
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_slot", _SLOT_BITS)
    keys = [] if ends is None else [f(F.struct(*order)).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    found = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*"), *keys).collect())
    if ends is not None and found:
        ends += [tuple(found[0][2]), tuple(found[-1][3])]
    stops = list(accumulate(r[1] for r in found))
    starts = [(r[0], stop - r[1]) for r, stop in zip(found, stops)]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    place = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    indexed = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*columns, (F.col("_start") + place).alias(name))
    )
    return indexed, stops[-1] if stops else 0
