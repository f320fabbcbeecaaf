"""Continuous ingest, counts and roots.

Rows are accepted at any age and placed by creation time, so there is no
watermark.  De-duplication is the append's anti join with the whole ledger,
which never forgets an id.  A micro-batch is stored with its number, so a
replayed one is left out.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from sealtrail.functions.rules import THREAT_PATTERN, threat_warning
from sealtrail.operators.ledger import REQUIRED_FIELDS, split_required, sync_rows
from sealtrail.operators.reports import count_by_device
from sealtrail.operators.sealing import seal_turns
from sealtrail.profile import SealProfile
from sealtrail.sources import runs as R
from sealtrail.sources.ledger_table import LedgerTable

# Fixed value: how often the reports refresh.
REFRESH = "3 seconds"

COUNTS_SCHEMA = "device_id string, n long"


def read_files(
    spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _triggered(writer: DataStreamWriter, checkpoint: str, once: bool) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=REFRESH)


def ledger_writer(
    rows: DataFrame, table: LedgerTable, checkpoint: str, *, once: bool = False
) -> DataStreamWriter:
    """Append ledger rows; each micro-batch stores a new root, once."""

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, batch_key=f"{checkpoint}#{number}")

    return _triggered(rows.writeStream.foreachBatch(write), checkpoint, once)


def stream_sync(
    source: DataFrame, synced_at_utc: Column, table: LedgerTable, checkpoint: str, *, once: bool = False
) -> DataStreamWriter:
    """Ingest pre-sealed rows, one ledger row per object id."""
    accepted, _ = sync_rows(source, synced_at_utc)
    return ledger_writer(accepted, table, checkpoint, once=once)


def stream_turns(
    source: DataFrame, profile: SealProfile, table: LedgerTable, checkpoint: str, *, once: bool = False
) -> DataStreamWriter:
    """Seal turns as they arrive and append them."""
    accepted, _ = split_required(source, REQUIRED_FIELDS["turn"])
    return ledger_writer(seal_turns(accepted, profile), table, checkpoint, once=once)


def stream_counts(
    rows: DataFrame, table: LedgerTable, out: str, checkpoint: str, *, once: bool = False
) -> DataStreamWriter:
    """Append ledger rows and keep counts by device of the rows stored.

    Each micro-batch adds the counts of the rows that it added to the counts before, as the
    version of its ledger batch; ``latest_counts`` reads the newest whole one.  An object that
    is sent again adds nothing.  Only the newest two versions stay: a reader may still be on
    the older one.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, batch_key=f"{checkpoint}#{number}")
        version = table.state().first().batch_no
        whole = _versions(batch.sparkSession, out)
        if version - 1 in whole:
            before = batch.sparkSession.read.schema(COUNTS_SCHEMA).parquet(f"{out}/version={version - 1}")
            added = before.unionByName(count_by_device(table.batch_rows(version)))
            added = added.groupBy("device_id").agg(F.sum("n").alias("n"))
        else:
            added = count_by_device(table.rows())
        added.write.mode("overwrite").parquet(f"{out}/version={version}")
        for old in whole:
            if old < version - 1:
                R.remove(batch.sparkSession, f"{out}/version={old}")

    return _triggered(rows.writeStream.foreachBatch(write), checkpoint, once)


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Versions of the counts that are wholly written."""
    names = [n for n in R.children(spark, out) if n.startswith("version=")]
    return [int(n.split("=")[1]) for n in names if any(p.startswith("part-") for p in R.children(spark, f"{out}/{n}"))]


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest whole version of the counts, or no row."""
    found = _versions(spark, out)
    if not found:
        return spark.createDataFrame([], COUNTS_SCHEMA)
    return spark.read.schema(COUNTS_SCHEMA).parquet(f"{out}/version={max(found)}")


def stream_threats(
    source: DataFrame, text: str, out: str, checkpoint: str, *, pattern: str = THREAT_PATTERN, once: bool = False
) -> DataStreamWriter:
    """Store the replies that carry a warning."""
    flagged = source.withColumn("warning", threat_warning(F.col(text), pattern)).where(
        F.col("warning").isNotNull()
    )
    writer = flagged.writeStream.format("parquet").option("path", out)
    return _triggered(writer, checkpoint, once)


def run_to_end(writer: DataStreamWriter) -> None:
    """Start a job that stops by itself and wait for it."""
    writer.start().awaitTermination()


