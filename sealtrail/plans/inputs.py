"""Ledgers and inputs made from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtrail.functions import json_text as J
from sealtrail.functions import sequence as Q
from sealtrail.functions import text as X
from sealtrail.operators import sealing
from sealtrail.profile import SealProfile
from sealtrail.sources.runs import CODEC
from sealtrail.sources.scratch import dropping_shuffles, new_folder
from sealtrail.sources.splits import spread_rows, spread_small

# A made-up key fingerprint and author.
PROFILE = SealProfile(
    key_sha256="5ea17a115ea17a115ea17a115ea17a115ea17a115ea17a115ea17a115ea17a11",
    author="Ledger Keeper",
)

SYNCED_AT = "2024-03-01T00:00:00.000Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy work per row."""
    return spread_small(table(spark, sf_dir, name))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints; it goes when the process ends."""
    return new_folder(spark)


def stored(rows: DataFrame) -> DataFrame:
    """The rows written to a table and read back, as a ledger would be kept."""
    folder = f"{scratch(rows.sparkSession)}/table"
    with dropping_shuffles(rows.sparkSession):
        rows.write.option("compression", CODEC).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def after_base(seconds: Column) -> Column:
    """ISO text of a fixed start time plus seconds."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return X.iso_utc(F.timestamp_add("SECOND", seconds, base))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a role, a creation time and an arrival number."""
    return turns_of(table(spark, sf_dir, "conversations"))


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", F.lit("agent")).otherwise(F.lit("human")).alias("role"),
        F.col("text").alias("content"),
        after_base(F.col("conv_id") * 60 + F.col("turn")).alias("created_at_utc"),
        (F.shiftleft("conv_id", 20) + F.col("turn")).alias("ingest_seq"),
    )


def turn_ledger(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Ledger of all turns, in arrival order."""
    return sealing.seal_turns(turns(spark, sf_dir), PROFILE, ("ingest_seq", *keep))


def exchange_ledger(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Ledger of the same turns sealed as chats, with parents."""
    spoken = turns(spark, sf_dir)
    source = F.when(F.col("turn") % 4 == 1, F.lit("model")).otherwise(F.lit("mock"))
    return sealing.seal_exchanges(spoken.withColumn("source", source), PROFILE, keep=("ingest_seq", *keep))


def event_ledger(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Ledger of device events, as devices would pre-seal them."""
    return event_ledger_of(spread_rows(table(spark, sf_dir, "events")), *keep)


def event_ledger_of(events: DataFrame, *keep: str) -> DataFrame:
    rows = events.select(
        "*",
        F.col("event_id").alias("ingest_seq"),
        X.iso_utc(F.col("ts")).alias("created_at_utc"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        F.when(F.col("event_type") == "purchase", F.lit("android"))
        .when(F.col("event_type") == "error", F.lit("cloud"))
        .otherwise(F.lit("web"))
        .alias("device_type"),
    )
    payload = F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"),
        F.lit(',"value":'), J.js_number(F.col("value")),
        F.lit(',"props":'), J.json_string(F.col("props")), F.lit("}"),
    )
    sealed = sealing.with_envelope(
        rows,
        PROFILE,
        payload=payload,
        object_type="device_event",
        release_class="public-safe",
        claim_type="device_event",
        statement=F.concat("event_type", F.lit(" on "), "device_id", F.lit(".")),
        claim_ceiling="Device event bound to public key.",
        created_at_utc=F.col("created_at_utc"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    ).withColumns(
        {
            "node_id": X.node_key(
                F.col("device_id"), F.lit("event"), F.col("event_id").cast("string")
            ),
            "payload_preview": F.concat("event_type", F.lit(": "), F.repeat("props", F.lit(30))),
            "claim_ceiling": F.lit("Device event."),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.lit(SYNCED_AT),
        }
    )
    carried = dict.fromkeys(("ingest_seq", *keep))
    return sealed.select(*carried, *sealing.S.LEDGER_TEXT_COLUMNS)


def sync_requests(events: DataFrame) -> DataFrame:
    """Pre-sealed events as sent: some fields blank, by type of event."""
    kind = F.col("event_type")
    gap = lambda c, when: F.when(kind == when, F.lit(None)).otherwise(F.col(c)).alias(c)
    sealed = event_ledger_of(events, "event_type")
    return sealed.select(
        F.when(kind == "signup", F.lit("")).otherwise(F.col("object_id")).alias("object_id"),
        gap("object_type", "view"),
        gap("content_leaf", "error"),
        "fco_root",
        "leaf_hash",
        gap("node_id", "view"),
        gap("parents_json", "purchase"),
        gap("envelope_json", "purchase"),
        "payload_preview",
        gap("claim_ceiling", "click"),
        gap("device_id", "view"),
        gap("device_type", "click"),
        gap("created_locally_at_utc", "purchase"),
    )


def sent_requests(spark: SparkSession, sf_dir: str) -> str:
    """Folder of Parquet files with the requests, as a device gateway leaves them."""
    folder = f"{scratch(spark)}/requests"
    sync_requests(spread(spark, sf_dir, "events")).write.parquet(folder)
    return folder


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue sequences: the letters of each document's text."""
    documents = spread(spark, sf_dir, "documents")
    return documents.select("doc_id", Q.sanitize_sequence(F.col("text")).alias("sequence"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field samples with a name, a place and a time."""
    return sequences(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        "sequence",
        ((F.col("doc_id") % 18000 - 9000) / F.lit(100.0)).alias("gps_lat"),
        ((F.col("doc_id") % 36000 - 18000) / F.lit(1000.0)).alias("gps_lng"),
        after_base(F.col("doc_id")).alias("created_at_utc"),
    )


def structure_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of fixed-width text files made from the order lines.

    Most lines are atom records; some are other records, too short, or without
    a number.  The order key and line number stand in columns 21-32 and 41-44.
    """
    rows = spread(spark, sf_dir, "lineitem")
    number = F.concat(
        F.col("l_quantity").cast("int").cast("string"),
        F.lit("."),
        F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 2, "0"),
    )
    untaxed = F.col("l_tax") == 0
    shown = F.when((F.col("l_linestatus") == "F") & untaxed, F.lit("n/a")).otherwise(number)
    record = F.when(F.col("l_returnflag") == "R", F.lit("HETATM")).otherwise(F.lit("ATOM"))
    line = F.concat(
        F.rpad(record, 20, " "),
        F.lpad(F.col("l_orderkey").cast("string"), 12, " "),
        F.lpad(F.col("l_linenumber").cast("string"), 12, " "),
        F.lpad(shown, 22, " "),
        F.lit("  C"),
    )
    short = (F.col("l_linestatus") == "O") & untaxed
    folder = f"{scratch(spark)}/structures"
    text = F.when(short, F.substring(line, 1, 64)).otherwise(line)
    rows.select(text.alias("value")).write.text(folder)
    return folder
