"""Tampering, decoded envelopes and parent edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sealtrail.operators import integrity, reports, sealing
from sealtrail.operators.ledger import number_rows


@pytest.fixture(scope="module")
def rows(spark, profile):
    turns = spark.createDataFrame(
        [(i // 4, i % 4, ("human", "agent")[i % 2], f"text {i} \x1f é", f"2024-01-01T00:00:{i:02d}.000Z") for i in range(20)],
        "conv_id long, turn long, role string, content string, created_at_utc string",
    )
    sealed = sealing.seal_exchanges(turns, profile)
    return number_rows(sealed, 0)[0]


def test_untouched_rows_pass(rows, profile):
    assert integrity.verify_rows(rows, profile).count() == 0


def test_root_form_leaf_passes(rows, profile):
    assert integrity.verify_rows(rows.withColumn("leaf_hash", F.col("fco_root")), profile).count() == 0


def test_reordered_envelope_text_passes(rows, profile):
    spaced = rows.withColumn("envelope_json", F.replace("envelope_json", F.lit('":{"'), F.lit('": {"')))
    assert integrity.verify_rows(spaced, profile).count() == 0


@pytest.mark.parametrize(
    "column,failed",
    [
        ("envelope_json", {"content_leaf"}),
        ("content_leaf", {"content_leaf", "object_id", "fco_root"}),
        ("object_id", {"object_id"}),
        ("fco_root", {"fco_root", "leaf_hash"}),
        ("leaf_hash", {"leaf_hash"}),
        ("node_id", {"leaf_hash"}),
    ],
)
def test_each_edit_is_named(rows, profile, column, failed):
    edited = rows.withColumn(
        column,
        F.when(F.col("ingest_seq") == 7, F.replace(column, F.lit("a"), F.lit("b"))).otherwise(F.col(column)),
    )
    found = integrity.verify_rows(edited, profile, ("ingest_seq",)).collect()
    assert {r.failed_check for r in found} == failed
    assert {r.ingest_seq for r in found} == {7}


def test_null_hash_fails(rows, profile):
    edited = rows.withColumn("fco_root", F.lit(None).cast("string"))
    assert {r.failed_check for r in integrity.verify_rows(edited, profile).collect()} == {"fco_root", "leaf_hash"}


def test_other_key_fails(rows, profile):
    other = type(profile)(key_sha256="00" * 32, author=profile.author)
    found = integrity.verify_rows(rows, other).collect()
    assert len(found) == 20 and {r.failed_check for r in found} == {"fco_root"}


def test_edges_and_dangling_parents(rows):
    edges = {tuple(r) for r in integrity.parent_edges(rows).collect()}
    assert len(edges) == 10
    assert integrity.dangling_parents(rows).count() == 0
    lost = next(iter(edges))[1]
    left = integrity.dangling_parents(rows.where(F.col("object_id") != lost)).collect()
    assert [tuple(r) for r in left] == [e for e in edges if e[1] == lost]


def test_hot_missing_parent_keeps_every_edge(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("o"), "id").alias("object_id"),
        F.when(F.col("id") % 3 == 0, '["gone"]').when(F.col("id") % 3 == 1, '["o1","gone2"]')
        .otherwise("").alias("parents_json"),
    )
    found = integrity.dangling_parents(rows).groupBy("parent").count().collect()
    assert {r.parent: r["count"] for r in found} == {"gone": 1000, "gone2": 1000}


def test_graph_and_detail(rows, profile):
    nodes = reports.graph_nodes(rows).collect()
    assert len(nodes) == 20 and sum(len(n.parents) for n in nodes) == 10
    blank = reports.graph_nodes(rows.withColumn("parents_json", F.lit(""))).first()
    assert blank.parents == []
    detail = reports.ledger_detail(rows).where("size(envelope.parents) > 0").first()
    assert detail.envelope.authorization.author == profile.author
    assert detail.envelope.parents == detail.parents
    assert detail.envelope.payload.byte_length > 0
