"""Ledger maintenance: validation, de-duplication, append, sync, look-up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail import schema as S
from sealtrail.functions.text import cut
from sealtrail.operators.ordering import with_dense_index
from sealtrail.operators.required import REQUIRED_FIELDS, split_any_required, split_required
from sealtrail.operators.sealing import optional

__all__ = ["REQUIRED_FIELDS", "split_any_required", "split_required"]


def complete() -> Column:
    """True for a row whose ledger text columns are all non-null."""
    return reduce(and_, [F.col(c).isNotNull() for c in S.LEDGER_TEXT_COLUMNS])


def first_per_object(
    df: DataFrame,
    order: Sequence[str] = ("synced_at_utc", "created_locally_at_utc"),
    keep_if: Column | None = None,
) -> DataFrame:
    """One row per object id, the first in ``order`` of those that ``keep_if`` accepts.

    An aggregate, not a window: copies collapse in each task before the
    shuffle, so an id with very many copies makes no hot partition.  The rest
    of the row breaks ties, so the choice does not depend on file order.  The
    test sits inside the aggregate, where it reads finished columns; as a
    filter it would move below the hash chain and repeat it per column.
    """
    rest = [c for c in df.columns if c != "object_id"]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    candidate = rank if keep_if is None else F.when(keep_if, rank)
    return (
        df.groupBy("object_id")
        .agg(F.min(candidate).alias("first"))
        .where(F.col("first").isNotNull())
        .select("object_id", *[F.col("first")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def valid_rows(
    batch: DataFrame, order: Sequence[str] = ("synced_at_utc", "created_locally_at_utc")
) -> DataFrame:
    """Complete rows, one per object id."""
    return first_per_object(batch, order, complete())


def new_rows(
    batch: DataFrame,
    ledger: DataFrame,
    order: Sequence[str] = ("synced_at_utc", "created_locally_at_utc"),
) -> DataFrame:
    """Rows an append would add: complete, first of their id, id not in the ledger."""
    fresh = valid_rows(batch, order)
    return fresh.join(ledger.select("object_id"), "object_id", "left_anti").select(*batch.columns)


def known_ids(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that the ledger already has.

    The ledger's id column is scanned once; whether the ids are broadcast to that
    scan is left to their size at run time.
    """
    return ledger.select("object_id").join(ids, "object_id", "left_semi")


def number_keys(keys: DataFrame, first_seq: int) -> tuple[DataFrame, int, str | None, str | None]:
    """Add dense ingest numbers by (created, object id) to keys of rows.

    Also returns their count, and the first and last time of creation.
    """
    ends: list[tuple] = []
    indexed, count = with_dense_index(keys, ["created_locally_at_utc", "object_id"], "_place", ends)
    numbered = indexed.select("*", (F.col("_place") + first_seq).alias("ingest_seq")).drop("_place")
    return numbered, count, *((ends[0][0], ends[1][0]) if ends else (None, None))


def number_rows(rows: DataFrame, first_seq: int) -> tuple[DataFrame, int]:
    """Add dense ingest numbers by (created, object id); also return the count."""
    order = ["created_locally_at_utc", "object_id"]
    indexed, count = with_dense_index(rows, order, "_place")
    numbered = indexed.withColumn("ingest_seq", F.col("_place") + first_seq)
    return numbered.select(*S.LEDGER_COLUMNS), count


def append_rows(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after an append, as one DataFrame."""
    highest = ledger.agg(F.coalesce(F.max("ingest_seq"), F.lit(-1)).alias("m")).first()["m"]
    added, _ = number_rows(new_rows(batch, ledger), highest + 1)
    return ledger.select(*S.LEDGER_COLUMNS).unionByName(added)


def sync_rows(batch: DataFrame, synced_at_utc: Column) -> tuple[DataFrame, DataFrame]:
    """Pre-sealed rows ready to append, and rejected rows with a reason.

    Absent or null fields get their defaults; content and leaf hashes have
    none, so such rows are dropped when appending.  Hashes are not checked
    here (see ``integrity.verify_rows``).
    """
    accepted, rejected = split_required(batch, REQUIRED_FIELDS["sync"])
    null_text = F.lit(None).cast("string")

    def field(name: str, default: Column = null_text) -> Column:
        return optional(accepted, name, default).alias(name)

    rows = accepted.select(
        "object_id",
        field("object_type", F.lit(S.SYNCED_TYPE)),
        field("content_leaf"),
        "fco_root",
        field("leaf_hash"),
        field("node_id", F.col("object_id")),
        field("parents_json", F.lit("[]")),
        field("envelope_json", F.lit("{}")),
        cut(field("payload_preview", F.lit("")), S.SYNC_PREVIEW_CHARS).alias("payload_preview"),
        field("claim_ceiling", F.lit(S.SYNC_CLAIM_CEILING)),
        field("device_id", F.lit(S.SYNC_DEVICE_ID)),
        field("device_type", F.lit(S.SYNC_DEVICE_TYPE)),
        field("created_locally_at_utc", synced_at_utc),
        synced_at_utc.alias("synced_at_utc"),
    )
    return rows, rejected


def ledger_scan(ledger: DataFrame) -> DataFrame:
    return ledger.select(*S.LEDGER_COLUMNS).orderBy(*S.LEDGER_ORDER)


def lookup_one(ledger: DataFrame, object_id: str) -> DataFrame:
    """The row of one object id, or no row."""
    return ledger.where(F.col("object_id") == object_id).limit(1)


def lookup(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of all ids in a one-column table of object ids.

    Repeated ids collapse before the join, so an id asked for very often costs
    one row there.
    """
    return ledger.join(ids.select("object_id").distinct(), "object_id", "left_semi")


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """Rows of several ledgers; of equal object ids, the first synced stays."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)
    order = [c for c in ("synced_at_utc", "ingest_seq") if c in rows.columns]
    return first_per_object(rows, order)


def seed_if_empty(ledger: DataFrame, seed: DataFrame) -> DataFrame:
    """The ledger, or the numbered seed rows if the ledger has none."""
    if not ledger.isEmpty():
        return ledger
    return number_rows(new_rows(seed, ledger), 0)[0]
