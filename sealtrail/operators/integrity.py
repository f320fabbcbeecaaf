"""Row verification and parent edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail.functions import hashing as H
from sealtrail.functions.json_text import canonical_json
from sealtrail.operators.reports import parents_array
from sealtrail.profile import SealProfile


def _content_ok() -> Column:
    """The content hash fits the stored text, or its canonical form."""
    stored = H.payload_hash(F.col("envelope_json")) == F.col("content_leaf")
    canonical = H.payload_hash(canonical_json(F.col("envelope_json"))) == F.col("content_leaf")
    return F.when(stored, F.lit(True)).otherwise(F.coalesce(canonical, F.lit(False)))


def failed_checks(profile: SealProfile) -> Column:
    """Names of the hash columns that do not fit the row they depend on.

    A leaf may have the node form or be the root itself.
    """
    root = H.key_bound_root(F.col("content_leaf"), F.lit(profile.key_sha256))
    node_leaf = H.leaf_hash(F.col("node_id"), F.col("fco_root"))
    checks = {
        "content_leaf": _content_ok(),
        "object_id": F.col("object_id") == H.object_key(F.col("content_leaf")),
        "fco_root": F.col("fco_root") == root,
        "leaf_hash": (F.col("leaf_hash") == F.col("fco_root"))
        | (F.col("leaf_hash") == node_leaf),
    }
    names = [
        F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in checks.items()
    ]
    return F.array_compact(F.array(*names))


def verify_rows(ledger: DataFrame, profile: SealProfile, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per failed check: object_id, failed_check.  No shuffle."""
    return ledger.select(
        *keep, "object_id", F.explode(failed_checks(profile)).alias("failed_check")
    )


def parent_edges(ledger: DataFrame) -> DataFrame:
    """Child and parent object ids."""
    return ledger.select(
        F.col("object_id").alias("child"), F.explode(parents_array()).alias("parent")
    )


def dangling_parents(ledger: DataFrame) -> DataFrame:
    """Edges whose parent is not in the ledger.

    Distinct parents are compared with the ledger first, so a parent with very
    many children costs one row in that join.  Edges then meet only the
    missing parents, which Spark broadcasts if they are few.
    """
    edges = parent_edges(ledger)
    ids = ledger.select(F.col("object_id").alias("parent"))
    missing = edges.select("parent").distinct().join(ids, "parent", "left_anti")
    return edges.join(missing, "parent", "left_semi").select("child", "parent")
