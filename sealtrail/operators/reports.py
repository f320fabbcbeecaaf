"""Ledger reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail import schema as S
from sealtrail.functions.hashing import hash_prefix
from sealtrail.functions.text import clock_time, cut
from sealtrail.operators.merkle import mountain_range

_LIVE_COLUMNS = (
    "object_id",
    "object_type",
    "fco_root",
    "device_id",
    "device_type",
    "created_locally_at_utc",
    "payload_preview",
)

_NODE_COLUMNS = (
    "object_id",
    "object_type",
    "fco_root",
    "leaf_hash",
    "device_id",
    "device_type",
    "node_id",
    "payload_preview",
    "claim_ceiling",
    "created_locally_at_utc",
    "synced_at_utc",
)


def parents_array() -> Column:
    """Decoded parent list; empty text is an empty list."""
    text = F.coalesce(F.nullif(F.col("parents_json"), F.lit("")), F.lit("[]"))
    return F.from_json(text, "array<string>")


def recent_leaves(ledger: DataFrame, rows: int = S.RECENT_ROWS) -> DataFrame:
    """The last rows in ledger order, newest first."""
    return ledger.orderBy(*[F.desc(c) for c in S.LEDGER_ORDER]).limit(rows)


def live_rows(ledger: DataFrame, rows: int = S.RECENT_ROWS) -> DataFrame:
    return recent_leaves(ledger, rows).select(*_LIVE_COLUMNS)


def touch_log(ledger: DataFrame, rows: int = S.RECENT_ROWS) -> DataFrame:
    """Display lines of the recent rows that have a root."""
    return (
        live_rows(ledger, rows)
        .where(F.length("fco_root") > 0)
        .select(
            "object_id",
            clock_time(F.col("created_locally_at_utc")).alias("time"),
            F.coalesce("device_type", F.lit(S.WEB_DEVICE_TYPE)).alias("device_type"),
            cut(
                F.coalesce("payload_preview", F.lit("")), S.TOUCH_PREVIEW_CHARS, "…"
            ).alias("preview"),
            hash_prefix(F.col("fco_root"), 12).alias("root_prefix"),
        )
    )


def graph_nodes(ledger: DataFrame) -> DataFrame:
    """Graph nodes with their decoded parent lists."""
    return ledger.select(*_NODE_COLUMNS, parents_array().alias("parents"))


def ledger_detail(ledger: DataFrame) -> DataFrame:
    """Detail rows with the envelope decoded."""
    return ledger.select(
        "object_id",
        F.from_json("envelope_json", S.ENVELOPE_SCHEMA).alias("envelope"),
        "payload_preview",
        "claim_ceiling",
        "device_id",
        "device_type",
        "node_id",
        parents_array().alias("parents"),
        "fco_root",
        "leaf_hash",
        "created_locally_at_utc",
        "synced_at_utc",
    )


def count_by_device(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("device_id").agg(F.count("*").alias("n"))


def devices_ranked(counts: DataFrame) -> DataFrame:
    """Device counts, largest first, ties by device id."""
    return counts.orderBy(F.desc("n"), "device_id")


def recent_by_device(ledger: DataFrame, rows: int = S.RECENT_ROWS) -> DataFrame:
    """Device counts over the recent rows only."""
    device = F.coalesce(F.nullif(F.col("device_id"), F.lit("")), F.lit(S.UNKNOWN_DEVICE))
    recent = recent_leaves(ledger.select(*S.LEDGER_ORDER, "device_id"), rows)
    return recent.groupBy(device.alias("device_id")).agg(F.count("*").alias("n"))


def leaf_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("leaf_count"))


def device_report(ledger: DataFrame) -> DataFrame:
    """Verification report: leaf count and recomputed root beside each device's count."""
    summary = mountain_range(ledger)
    return count_by_device(ledger).select(
        F.lit(summary.leaf_count).cast("long").alias("leaf_count"),
        F.lit(summary.root).alias("merkle_root"),
        "device_id",
        "n",
    )


def root_check(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored beside recomputed root.  Nothing is written."""
    summary = mountain_range(ledger)
    return stored.select(
        F.col("merkle_root").alias("stored_root"),
        F.lit(summary.root).alias("computed_root"),
        (F.col("merkle_root") == F.lit(summary.root)).alias("root_matches"),
    )


def usable_state(states: DataFrame) -> DataFrame:
    """Stored states that can be used: a root, and at least one leaf."""
    return states.where((F.length("merkle_root") > 0) & (F.col("leaf_count") > 0))
