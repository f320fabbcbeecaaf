"""Runs, buckets, block nodes and merging of the stored ledger."""

from __future__ import annotations

import random
import time
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sealtrail.operators import ledger, merkle
from sealtrail.plans import inputs
from sealtrail.sources import ledger_table, runs
from sealtrail.sources.ledger_table import LedgerTable
from tests.test_ledger import root_by_hand, rows_of


@pytest.fixture
def table(spark, tmp_path):
    return LedgerTable(spark, str(tmp_path / "ledger"))


def scanned(df) -> int:
    """Rows that the scans of an executed plan have returned."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
            continue
        if plan.nodeName().startswith("Scan parquet"):
            total += plan.metrics().apply("numOutputRows").value()
        inner = [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        children = plan.children()
        todo += inner + [children.apply(i) for i in range(children.length())]
    return total


def test_merge_plan():
    assert runs.merge_from([]) is None and runs.merge_from([5] * 7) is None
    assert runs.merge_from([5] * 8) == 0 and runs.merge_from([10**7] + [5] * 8) == 1
    assert runs.merge_from([40] + [5] * 8) == 0 and runs.merge_from([41] + [5] * 8) == 1
    for kinds in ([1], [1, 10, 5000], [1] * 9 + [10**6]):
        random_, sizes, most, written = random.Random(2), [], 0, 0
        for _ in range(2000):
            sizes.append(random_.choice(kinds))
            if (start := runs.merge_from(sizes)) is not None:
                sizes[start:] = [sum(sizes[start:])]
                written += sizes[-1]
            most = max(most, len(sizes))
        assert most <= runs.FAN * 3
        assert written <= sum(sizes) * sum(sizes).bit_length()


def test_late_rows_fold_from_their_block(spark, table, monkeypatch):
    """Ten micro-batches in a shuffled order; each has rows among those before."""
    rng = random.Random(5)
    batches, number = [], 0
    lows = [0, 200, 400, 600, 800, 300, 790, 900, 50, 999]
    for low in lows:
        batch = []
        for _ in range(rng.choice([700, 1500])):
            batch.append((f"n{number}", str(low + rng.randint(0, 220)).zfill(5)))
            number += 1
        batches.append(batch)
    folded = []
    fold = merkle.perfect_trees

    def seen(rows, start, end, **kw):
        if kw.get("index", "leaf_index") == "leaf_index":
            folded.append((start, end))
        return fold(rows, start, end, **kw)

    monkeypatch.setattr(ledger_table, "perfect_trees", seen)
    for i, batch in enumerate(batches):
        assert table.append(rows_of(spark, batch)).root == root_by_hand(batches[: i + 1])
    assert merkle.ledger_root(table.rows()).first().merkle_root == table.root().first().merkle_root
    # A late batch starts at a block's border or at a snapshot that is still a prefix.
    sizes = [0]
    for batch in batches:
        sizes.append(sizes[-1] + len(batch))
    assert all(start % ledger_table.BLOCK == 0 or start in sizes for start, _ in folded)
    assert any(start and start not in sizes for start, _ in folded)
    # Some rows date late in the ledger: most leaves are not read again.
    one = [("late", "01000")]
    table.append(rows_of(spark, one))
    start, end = folded[-1]
    assert end == number + 1 and end - start < number / 2
    assert table.root().first().merkle_root == root_by_hand([*batches, one])


def test_many_batches_leave_few_files(spark, table, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 3)
    monkeypatch.setattr(ledger_table, "HISTORY_STEP", 4)
    rng = random.Random(3)
    batches = [[(f"b{i}-{j}", str(rng.randint(0, 40)).zfill(3)) for j in range(3)] for i in range(11)]
    for i, batch in enumerate(batches):
        before = [] if i == 0 else batches[i - 1]
        summary = table.append(rows_of(spark, batch + before))
    assert summary.root == root_by_hand(batches) == table.root().first().merkle_root
    assert sorted(r.ingest_seq for r in table.rows().collect()) == list(range(33))
    state = table._last()
    assert len(state.row_runs) <= 4 and len(state.id_runs) <= 4 and len(state.history_runs) <= 3
    assert len(runs.children(spark, f"{table.path}/rows")) <= 8
    assert len(runs.children(spark, f"{table.path}/state")) <= 9
    found = table.states().orderBy("batch_no").collect()
    assert [r.batch_no for r in found] == list(range(11)) and {r.rows_added for r in found} == {3}
    for i in (0, 5, 10):
        assert found[i].merkle_root == root_by_hand(batches[: i + 1])
        assert {r.object_id for r in table.batch_rows(i).collect()} == {n for n, _ in batches[i]}


def test_append_reads_its_own_buckets(spark, table, monkeypatch):
    monkeypatch.setattr(ledger_table, "IDS_PER_BUCKET", 32)
    table.append(rows_of(spark, [(f"r{i}", "1") for i in range(2000)]))
    table.append(rows_of(spark, [(f"s{i}", "2") for i in range(10)]))
    last = table._last()
    ask = spark.createDataFrame([("r7",), ("r8",), ("new",)], "object_id string")
    files = table._ids(last, ask).inputFiles()
    assert 0 < len({f.rsplit("/", 2)[1] for f in files if "batch_no=0" in f}) <= 3
    assert ledger_table.buckets(2000) == 64
    assert scanned(table._ids(last, ask)) < 300
    summary = table.append(rows_of(spark, [("r7", "3"), ("new", "3"), ("s1", "3")]))
    assert summary.leaf_count == 2011


def test_late_batch_is_sent_to_the_stored_ids(spark, table, monkeypatch):
    """Its keys meet only the ids that both have."""
    first, late = [(f"id-{n}", "2024-01-02") for n in range(3000)], [("id-7", "2024-01-01"), ("id-new", "2024-01-01")]
    table.append(rows_of(spark, first))
    plans, number = [], ledger_table.number_keys

    def numbered(keys, first_seq):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return number(keys, first_seq)

    monkeypatch.setattr(ledger_table, "number_keys", numbered)
    table.append(rows_of(spark, late))
    assert "LeftSemi" in plans[0] and "LeftAnti" in plans[0]
    assert table.rows().count() == 3001
    assert table.root().first().merkle_root == merkle.ledger_root(table.rows()).first().merkle_root


def test_lookup_skips_most_rows(spark, table, monkeypatch):
    items = [(f"r{i}", str(i).zfill(6)) for i in range(60_000)]
    monkeypatch.setattr(ledger_table, "ROWS_PER_FILE", 4096)
    monkeypatch.setattr(ledger_table, "IDS_PER_BUCKET", 1024)
    table.append(rows_of(spark, items))
    wanted = [f"r{i}" for i in range(20_000, 20_010)]
    ask = spark.createDataFrame([(w,) for w in [*wanted, wanted[0], "none"]], "object_id string")
    found = table.lookup(ask)
    assert sorted(r.object_id for r in found.collect()) == wanted
    assert scanned(found) < 60_000 / 10
    monkeypatch.setattr(ledger_table, "LOOKUP_MOST", 3)
    assert sorted(r.object_id for r in table.lookup(ask).collect()) == wanted
    assert LedgerTable(spark, table.path + "-none").lookup(ask).count() == 0


def test_many_prefixes_are_thinned():
    kept = []
    for i in range(1000):
        kept = LedgerTable._thinned([*kept, i])
    assert len(kept) <= 2 * ledger_table.PREFIXES and kept == sorted(kept)
    assert kept[-ledger_table.PREFIXES :] == list(range(1000 - ledger_table.PREFIXES, 1000))


def test_keys_are_numbered_by_time(spark):
    keys = spark.createDataFrame([("b", "2"), ("a", "2"), ("c", "1")], "object_id string, created_locally_at_utc string")
    numbered, count, low, high = ledger.number_keys(keys, 5)
    assert (count, low, high) == (3, "1", "2")
    assert {r.object_id: r.ingest_seq for r in numbered.collect()} == {"c": 5, "a": 6, "b": 7}
    assert ledger.number_keys(keys.where(F.lit(False)), 5)[1:] == (0, None, None)


def shuffled(spark) -> set[str]:
    """Shuffle files with contents that are on this machine's disk now."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [found.apply(i) for i in range(found.size())]
    return {f.getName() for f in files if f.getName().startswith("shuffle_") and f.length()}


def test_append_leaves_nothing_beside_the_ledger(spark, table):
    """Shuffle files and the batch's sealed rows go with the append, and the setting for that is put back."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, value = shuffled(spark), spark.conf.get(setting)
    for low in (0, 300):
        table.append(rows_of(spark, [(f"r{i}", str(i % 7)) for i in range(low, low + 500)]).repartition(5))
    # Spark removes them in the background.
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    left = shuffled(spark) - before
    assert not left and spark.conf.get(setting) == value
    assert runs.children(spark, f"{table.path}/incoming") == []
    assert table.rows().count() == 800


def test_rows_are_written_in_slices(spark, table, monkeypatch):
    """Times that are shared across slices, repeated and known ids, a late batch: numbered as by one pass."""
    for name, value in (("ROWS_PER_FILE", 8), ("FILES_PER_SLICE", 1), ("FILES_PER_CORE", 0), ("MOST_SLICES", 4)):
        monkeypatch.setattr(ledger_table, name, value)
    wrote, write = [], LedgerTable._write_rows

    def seen(self, fresh, added, folder, first_seq, count):
        kept = LedgerTable._write

        def one(self, rows, to, mode="overwrite", *by):
            if to == folder:
                wrote.append((rows.count(), mode))
            kept(self, rows, to, mode, *by)

        with monkeypatch.context() as patch:
            patch.setattr(LedgerTable, "_write", one)
            write(self, fresh, added, folder, first_seq, count)

    monkeypatch.setattr(LedgerTable, "_write_rows", seen)
    first = [(f"r{i}", f"2{i % 3}") for i in range(100)] * 2
    late = [(f"s{i}", "10" if i % 2 else "21") for i in range(50)] + first[:60]
    table.append(rows_of(spark, first).repartition(3))
    table.append(rows_of(spark, late).repartition(3))
    assert wrote == [(32, "overwrite"), (32, "append"), (32, "append"), (4, "append"), (16, "overwrite"), (16, "append"), (16, "append"), (2, "append")]
    expected = sorted((c, n) for n, c in set(first)) + sorted((c, n) for n, c in late[:50])
    got = sorted((r.ingest_seq, r.created_locally_at_utc, r.object_id) for r in table.rows().collect())
    named = {r.object_id: r.created_locally_at_utc for r in rows_of(spark, first + late).collect()}
    assert [i for i, _, _ in got] == list(range(150)) and {n: c for _, c, n in got} == named
    assert [c for _, c, _ in got] == [c for c, _ in expected]
    assert [n for _, _, n in got[:100]] == [n for _, n in sorted((c, n) for _, c, n in got[:100])]
    assert table.root().first().merkle_root == merkle.ledger_root(table.rows()).first().merkle_root


def codecs(rows) -> set[str]:
    """How the Parquet files with rows of a table are packed."""
    found = [pq.ParquetFile(urlparse(f).path).metadata for f in rows.inputFiles()]
    return {m.row_group(0).column(0).compression for m in found if m.num_rows}


def test_ledger_rows_are_packed(spark, table):
    """Hashes as text take about half of their size on disk."""
    table.append(rows_of(spark, [("a", "1"), ("b", "2")]))
    assert codecs(table.rows()) == {"ZSTD"} == codecs(table._ids(table._last(), table.rows()))


def test_stored_tables_are_packed(spark):
    assert codecs(inputs.stored(rows_of(spark, [("a", "1"), ("b", "2")]))) == {"ZSTD"}
