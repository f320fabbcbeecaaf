"""Streams end with the batch result, also after overlap and restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sealtrail.operators import ledger, merkle
from sealtrail.operators.reports import count_by_device
from sealtrail.plans import queries
from sealtrail.sources.ledger_table import LedgerTable
from sealtrail.sources.runs import children
from sealtrail.streaming import jobs
from tests.test_ledger import rows_of


@pytest.fixture
def folder(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "ledger", "checkpoint", "out")}


def requests(spark, low, high):
    items = [(f"r{i}", str(i % 9), "x") for i in range(low, high)]
    return rows_of(spark, items).drop("synced_at_utc")


def sync_all(spark, folder, table):
    schema = requests(spark, 0, 1).schema
    source = jobs.read_files(spark, folder["in"], schema, max_files=1)
    jobs.run_to_end(jobs.stream_sync(source, F.lit("2030"), table, folder["checkpoint"], once=True))


def test_sync_stream_with_overlap_and_restart(spark, folder):
    table = LedgerTable(spark, folder["ledger"])
    for low, high in ((0, 30), (20, 50)):
        requests(spark, low, high).coalesce(1).write.mode("append").parquet(folder["in"])
    sync_all(spark, folder, table)
    assert table.states().count() == 2
    requests(spark, 10, 60).coalesce(1).write.mode("append").parquet(folder["in"])
    sync_all(spark, folder, table)
    rows = table.rows()
    assert sorted(r.object_id for r in rows.collect()) == sorted(f"r{i}" for i in range(60))
    states = table.states().orderBy("batch_no").collect()
    assert states[-1].leaf_count == 60 and len(states) == 3
    assert states[-1].merkle_root == merkle.ledger_root(rows).first().merkle_root
    once, _ = ledger.sync_rows(requests(spark, 0, 60), F.lit("2030"))
    columns = list(ledger.S.LEDGER_TEXT_COLUMNS)
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, once.select(columns).collect()))


def test_counts_stream(spark, folder):
    rows_of(spark, [(f"{c}{i}", "1") for c in "abb" for i in range(3)]).repartition(3).write.parquet(folder["in"])
    rows_of(spark, [("a0", "1"), ("c0", "1")]).write.mode("append").parquet(folder["in"])
    source = jobs.read_files(spark, folder["in"], spark.read.parquet(folder["in"]).schema, max_files=1)
    table = LedgerTable(spark, folder["ledger"])
    jobs.run_to_end(jobs.stream_counts(source, table, folder["out"], folder["checkpoint"], once=True))
    got = {r.device_id: r.n for r in jobs.latest_counts(spark, folder["out"]).collect()}
    assert got == {r.device_id: r.n for r in count_by_device(table.rows()).collect()}
    assert got == {"dev-a": 3, "dev-b": 3, "dev-c": 1}
    assert table.states().count() > 3 and len(children(spark, folder["out"])) == 2


def test_no_counts_yet(spark, folder):
    assert jobs.latest_counts(spark, folder["out"]).count() == 0


def test_replayed_batch_leaves_one_state(spark, folder):
    table = LedgerTable(spark, folder["ledger"])
    rows = rows_of(spark, [("a", "1"), ("b", "2")])
    first = table.append(rows, batch_key="q#0")
    assert table.append(rows, batch_key="q#0") == first
    assert table.states().count() == 1
    table.append(rows, batch_key="q#1")
    assert table.states().count() == 2


def test_turn_stream_skips_blank_turns(spark, folder, profile):
    turns = spark.createDataFrame(
        [("human", "q", "2024"), ("agent", "", "2025"), (None, "x", "2026"), ("agent", "a", "2027")],
        "role string, content string, created_at_utc string",
    )
    turns.write.parquet(folder["in"])
    table = LedgerTable(spark, folder["ledger"])
    source = jobs.read_files(spark, folder["in"], turns.schema)
    jobs.run_to_end(jobs.stream_turns(source, profile, table, folder["checkpoint"], once=True))
    rows = table.rows().orderBy("ingest_seq").collect()
    assert [(r.device_id, r.created_locally_at_utc) for r in rows] == [("web-demo", "2024"), ("sauna-agent", "2027")]


def test_threat_stream(spark, folder):
    replies = spark.createDataFrame([(1, "All clear"), (2, "A TOXIN!")], "id int, text string")
    replies.write.parquet(folder["in"])
    source = jobs.read_files(spark, folder["in"], replies.schema)
    jobs.run_to_end(jobs.stream_threats(source, "text", folder["out"], folder["checkpoint"], once=True))
    assert [r.id for r in spark.read.parquet(folder["out"]).collect()] == [2]


def test_arrivals_are_two_batches_of_many_files(spark, tmp_path):
    """Each part is one micro-batch, and no single task writes it."""
    seen = []

    def write(batch, number):
        found = batch.select("id", F.input_file_name().alias("file")).collect()
        seen.append((number, sorted(r.id for r in found), len({r.file for r in found})))

    def job(source):
        writer = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint")
        return writer.trigger(availableNow=True)

    even = F.col("id") % 2 == 0
    queries._in_two_arrivals(spark.range(0, 40, 1, 4), even, ~even, job)
    assert [s[:2] for s in seen] == [(0, list(range(0, 40, 2))), (1, list(range(1, 40, 2)))]
    assert all(files == 4 for *_, files in seen)
