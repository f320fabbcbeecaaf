"""Append, sync and the stored ledger."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sealtrail import schema as S
from sealtrail.operators import ledger, merkle, reports
from sealtrail.sources.ledger_table import LedgerTable
from tests import by_hand


def rows_of(spark, items):
    """Ledger rows from (name, created) or (name, created, synced)."""
    full = [(*i, "2030") if len(i) == 2 else i for i in items]
    df = spark.createDataFrame(full, "name string, created string, synced string")
    values = {c: F.concat(F.lit(f"{c}:"), "name") for c in S.LEDGER_TEXT_COLUMNS}
    values |= {
        "object_id": F.col("name"),
        "leaf_hash": F.sha2("name", 256),
        "created_locally_at_utc": F.col("created"),
        "synced_at_utc": F.col("synced"),
        "device_id": F.concat(F.lit("dev-"), F.substring("name", 1, 1)),
        "parents_json": F.lit("[]"),
    }
    return df.select(*[values[c].alias(c) for c in S.LEDGER_TEXT_COLUMNS])


def root_by_hand(batches):
    """Root of batches of distinct (name, created), numbered within each batch."""
    order = []
    for number, batch in enumerate(batches):
        order += [(created, number, name) for name, created in batch]
    return by_hand.root([by_hand.sha(name) for _, _, name in sorted(order)])


@pytest.fixture
def table(spark, tmp_path):
    return LedgerTable(spark, str(tmp_path / "ledger"))


def test_empty_ledger(table, spark):
    assert table.rows().count() == 0
    assert tuple(table.root().first()) == (0, "0" * 64)
    table.append(rows_of(spark, [("a", "1")]).where("false"))
    assert tuple(table.root().first()) == (0, "0" * 64)
    assert reports.usable_state(table.states()).count() == 0
    table.append(rows_of(spark, [("a", "1")]))
    assert tuple(table.root().first()) == (1, by_hand.sha("a"))
    assert reports.usable_state(table.states()).count() == 1


def test_append_is_idempotent(table, spark):
    batch = rows_of(spark, [(f"r{i}", str(i % 5)) for i in range(50)])
    first = table.append(batch)
    before = sorted(map(tuple, table.rows().collect()))
    again = table.append(batch.unionByName(batch))
    assert again == first
    assert sorted(map(tuple, table.rows().collect())) == before
    assert [r.rows_added for r in table.states().orderBy("batch_no").collect()] == [50, 0]


def test_numbers_are_dense_over_batches(table, spark):
    table.append(rows_of(spark, [("b", "2"), ("a", "1")]))
    table.append(rows_of(spark, [("b", "2"), ("d", "1"), ("c", "3")]))
    got = {r.object_id: r.ingest_seq for r in table.rows().collect()}
    assert got == {"a": 0, "b": 1, "d": 2, "c": 3}


def test_incomplete_rows_do_not_claim_their_id(table, spark):
    good = rows_of(spark, [("a", "2", "2031"), ("b", "1")])
    bad = rows_of(spark, [("a", "1", "2029")]).withColumn("claim_ceiling", F.lit(None).cast("string"))
    table.append(good.unionByName(bad))
    got = {r.object_id: r.synced_at_utc for r in table.rows().collect()}
    assert got == {"a": "2031", "b": "2030"}


def test_first_synced_copy_stays(spark):
    copies = [("hot", str(i), f"20{i:02d}") for i in range(5, 60)] + [("one", "1", "2000")]
    kept = ledger.first_per_object(rows_of(spark, copies).repartition(7))
    got = {r.object_id: r.created_locally_at_utc for r in kept.collect()}
    assert got == {"hot": "5", "one": "1"}


def test_roots_after_late_and_tied_batches(table, spark):
    rng = random.Random(11)
    batches, number = [], 0
    for low, high in ((10, 20), (20, 30), (30, 40), (25, 45), (45, 46), (0, 50), (50, 60), (60, 60)):
        batch = []
        for _ in range(rng.randint(1, 40)):
            batch.append((f"n{number}", str(rng.randint(low, high)).zfill(3)))
            number += 1
        batches.append(batch)
        summary = table.append(rows_of(spark, batch))
        expected = root_by_hand(batches)
        assert summary.root == expected
        assert tuple(table.root().first()) == (number, expected)
        assert merkle.ledger_root(table.rows()).first().merkle_root == expected


def test_in_order_batches_fold_only_new_rows(table, spark, monkeypatch):
    table.append(rows_of(spark, [(f"a{i}", "1") for i in range(20)]))
    table.append(rows_of(spark, [(f"b{i}", "3") for i in range(20)]))
    seen = []
    fold = merkle.perfect_trees
    monkeypatch.setattr(
        "sealtrail.sources.ledger_table.perfect_trees",
        lambda rows, start, end, **kw: seen.append((start, end)) or fold(rows, start, end, **kw),
    )
    table.append(rows_of(spark, [("c", "3")]))
    table.append(rows_of(spark, [("late", "2")]))
    assert seen == [(40, 41), (20, 42)]


def test_uncommitted_batch_is_invisible_and_overwritten(table, spark):
    table.append(rows_of(spark, [("a", "1")]))
    left_over = ledger.number_rows(rows_of(spark, [("x", "9")]), 1)[0]
    left_over.write.parquet(f"{table.path}/rows/batch_no=1")
    assert [r.object_id for r in table.rows().collect()] == ["a"]
    summary = table.append(rows_of(spark, [("b", "2")]))
    assert sorted(r.object_id for r in table.rows().collect()) == ["a", "b"]
    assert summary.root == root_by_hand([[("a", "1")], [("b", "2")]])


def test_left_over_rows_do_not_join_an_empty_batch(table, spark):
    table.append(rows_of(spark, [("a", "1")]))
    left_over = ledger.number_rows(rows_of(spark, [("x", "9")]), 1)[0]
    left_over.write.parquet(f"{table.path}/rows/batch_no=1")
    table.append(rows_of(spark, [("a", "1")]))
    assert [r.object_id for r in table.rows().collect()] == ["a"]


def test_overlapping_batches(table, spark):
    table.append(rows_of(spark, [(f"r{i}", "1") for i in range(10)]))
    table.append(rows_of(spark, [(f"r{i}", "1") for i in range(5, 15)]))
    assert sorted(r.ingest_seq for r in table.rows().collect()) == list(range(15))


def test_append_as_one_dataframe(spark):
    old, _ = ledger.number_rows(rows_of(spark, [("a", "1"), ("b", "2")]), 0)
    both = ledger.append_rows(old, rows_of(spark, [("b", "2"), ("c", "0")]))
    assert {r.object_id: r.ingest_seq for r in both.collect()} == {"a": 0, "b": 1, "c": 2}
    scanned = [r.object_id for r in ledger.ledger_scan(both).collect()]
    assert scanned == ["c", "a", "b"]


def test_lookup(spark):
    rows, _ = ledger.number_rows(rows_of(spark, [("a", "1"), ("b", "2"), ("c", "3")]), 0)
    assert ledger.lookup_one(rows, "b").first().node_id == "node_id:b"
    assert ledger.lookup_one(rows, "zz").count() == 0
    ids = spark.createDataFrame([("a",), ("c",), ("c",), ("q",)], "object_id string")
    assert sorted(r.object_id for r in ledger.lookup(rows, ids).collect()) == ["a", "c"]


def test_sync_defaults_and_rejects(spark):
    sent = spark.createDataFrame(
        [
            ("o1", "root", "leaf", "content", None, "p" * 300),
            ("", "root", "leaf", "content", "t", "p"),
            ("o3", None, "leaf", "content", "t", "p"),
            ("o4", "root", None, "content", "t", None),
        ],
        "object_id string, fco_root string, leaf_hash string, content_leaf string, "
        "created_locally_at_utc string, payload_preview string",
    )
    rows, rejected = ledger.sync_rows(sent, F.lit("now"))
    got = {r.object_id: r for r in rows.collect()}
    assert set(got) == {"o1", "o4"}
    one = got["o1"].asDict()
    assert one == {
        "object_id": "o1", "object_type": "synced_fco", "content_leaf": "content",
        "fco_root": "root", "leaf_hash": "leaf", "node_id": "o1", "parents_json": "[]",
        "envelope_json": "{}", "payload_preview": "p" * 200,
        "claim_ceiling": "Synced FCO; verification pending.", "device_id": "unknown-device",
        "device_type": "cloud", "created_locally_at_utc": "now", "synced_at_utc": "now",
    }
    assert got["o4"].leaf_hash is None and got["o4"].payload_preview == ""
    assert sorted(r.reason for r in rejected.collect()) == ["fco_root required", "object_id required"]
    assert [r.object_id for r in ledger.valid_rows(rows).collect()] == ["o1"]


def test_required_either(spark):
    asked = spark.createDataFrame(
        [("S", None), ("", "P1"), (None, ""), (None, None)], "sequence string, uniprot string"
    )
    good, bad = ledger.split_any_required(asked, ("sequence", "uniprot"))
    assert good.count() == 2
    assert [r.reason for r in bad.collect()] == ["sequence or uniprot required"] * 2


def test_union_keeps_first_synced(spark):
    one = rows_of(spark, [("a", "1", "2024"), ("b", "1", "2024")])
    two = rows_of(spark, [("b", "1", "2023"), ("c", "1", "2023")]).drop("node_id")
    got = {r.object_id: r.synced_at_utc for r in ledger.union_ledgers(one, two).collect()}
    assert got == {"a": "2024", "b": "2023", "c": "2023"}


def test_seed_only_when_empty(spark):
    seed = rows_of(spark, [("s1", "1"), ("s2", "2"), ("s2", "2")])
    empty, _ = ledger.number_rows(seed.where("false"), 0)
    seeded = ledger.seed_if_empty(empty, seed)
    assert seeded.count() == 2
    full, _ = ledger.number_rows(rows_of(spark, [("x", "1")]), 0)
    assert [r.object_id for r in ledger.seed_if_empty(full, seed).collect()] == ["x"]


def test_reports(spark):
    items = [(f"{'ab'[i % 2]}{i}", str(i).zfill(2)) for i in range(30)]
    rows, _ = ledger.number_rows(rows_of(spark, items), 0)
    assert {r.device_id: r.n for r in reports.count_by_device(rows).collect()} == {"dev-a": 15, "dev-b": 15}
    blank = rows.withColumn("device_id", F.when(F.col("ingest_seq") == 29, "").otherwise(F.col("device_id")))
    recent = {r.device_id: r.n for r in reports.recent_by_device(blank).collect()}
    assert recent == {"dev-a": 6, "dev-b": 5, "unknown": 1}
    assert [r.object_id for r in reports.live_rows(rows).collect()] == [items[i][0] for i in range(29, 17, -1)]
    ranked = reports.devices_ranked(reports.count_by_device(rows.where("ingest_seq < 29")))
    assert [tuple(r) for r in ranked.collect()] == [("dev-a", 15), ("dev-b", 14)]
    log = reports.touch_log(rows.withColumn("fco_root", F.when(F.col("ingest_seq") < 28, "r" * 64)))
    assert log.count() == 10
    assert reports.leaf_count(rows).first().leaf_count == 30
    report = reports.device_report(rows).collect()
    assert {r.merkle_root for r in report} == {root_by_hand([items])}


def test_root_check_does_not_write(spark, table):
    batch = rows_of(spark, [(f"r{i}", "1") for i in range(9)])
    table.append(batch)
    good = reports.root_check(table.rows(), table.root()).first()
    assert good.root_matches and good.stored_root == good.computed_root
    edited = table.rows().withColumn("leaf_hash", F.reverse("leaf_hash"))
    assert not reports.root_check(edited, table.root()).first().root_matches
    assert table.states().count() == 1
