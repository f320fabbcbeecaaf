"""The root against a fold by hand, and its properties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sealtrail.operators import merkle
from sealtrail.operators.ordering import with_dense_index
from tests import by_hand


def leaves(spark, start, end, created=None):
    created = F.lit("t") if created is None else created
    return spark.range(start, end, numPartitions=3).select(
        created.cast("string").alias("created_locally_at_utc"),
        F.col("id").alias("ingest_seq"),
        F.sha2(F.col("id").cast("string"), 256).alias("leaf_hash"),
    )


def hashes(order):
    return [by_hand.sha(str(i)) for i in order]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 8, 9, 1023, 1024, 2500])
def test_root_of_n_leaves(spark, n):
    row = merkle.ledger_root(leaves(spark, 0, n)).first()
    assert (row.leaf_count, row.merkle_root) == (n, by_hand.root(hashes(range(n))))


def test_order_is_creation_text_then_ingest_number(spark):
    ledger = leaves(spark, 0, 300, created=F.col("id") % 7)
    expected = sorted(range(300), key=lambda i: (str(i % 7), i))
    assert merkle.ledger_root(ledger).first().merkle_root == by_hand.root(hashes(expected))
    shuffled = ledger.orderBy(F.hash("ingest_seq")).repartition(5)
    assert merkle.ledger_root(shuffled).first().merkle_root == by_hand.root(hashes(expected))


def test_one_hot_creation_time_splits_over_partitions(spark):
    hot = leaves(spark, 0, 20000, created=F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5))
    indexed, count = with_dense_index(hot, ["created_locally_at_utc", "ingest_seq"])
    rows = indexed.orderBy("leaf_index").collect()
    assert count == 20000
    assert [r.leaf_index for r in rows] == list(range(20000))
    keys = [(r.created_locally_at_utc, r.ingest_seq) for r in rows]
    assert keys == sorted(keys)


def test_any_changed_leaf_changes_the_root(spark):
    ledger = leaves(spark, 0, 40)
    roots = {merkle.ledger_root(ledger).first().merkle_root}
    for at in (0, 17, 39):
        edited = ledger.withColumn(
            "leaf_hash",
            F.when(F.col("ingest_seq") == at, F.lit("0" * 64)).otherwise(F.col("leaf_hash")),
        )
        roots.add(merkle.ledger_root(edited).first().merkle_root)
    assert len(roots) == 4


@pytest.mark.parametrize("first,total", [(0, 5), (1, 2), (3, 4), (5, 1100), (1000, 1031), (777, 3000)])
def test_extending_equals_folding_all(spark, first, total):
    def indexed(start, end):
        return leaves(spark, start, end).withColumnRenamed("ingest_seq", "leaf_index")

    base = merkle.MountainRange().extended(merkle.perfect_trees(indexed(0, first), 0, first))
    whole = base.extended(merkle.perfect_trees(indexed(first, total), first, total))
    assert whole.leaf_count == total
    assert whole.root == by_hand.root(hashes(range(total)))


def test_gap_in_positions_is_refused(spark):
    gap = leaves(spark, 0, 8).withColumnRenamed("ingest_seq", "leaf_index").where("leaf_index <> 3")
    with pytest.raises(Exception, match="not dense"):
        merkle.perfect_trees(gap, 0, 8)


def test_dense_index_of_nothing(spark):
    indexed, count = with_dense_index(leaves(spark, 0, 0), ["ingest_seq"])
    assert (count, indexed.count()) == (0, 0)
