"""Every registered query against its SQL counterpart on the sample tables."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sealtrail.plans.oracles import ORACLES
from sealtrail.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(row[i] for i in order) for row in rows]
    floats = [tuple(float(v) if isinstance(v, (int, float)) else v for v in row) for row in plain]
    return [columns[i] for i in order], sorted(floats, key=repr)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got = values(result.columns, [tuple(r) for r in result.collect()])
    cursor = duck.execute(ORACLES[name])
    expected = values([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1]


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.device_id for r in rows} == {"web-demo", "sauna-agent"}
    assert sum(r.n for r in rows) == rows[0].leaf_count


def test_core_queries_without_the_optional_libraries(monkeypatch):
    """The core is registered whatever the training-data subpackage lacks."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.warns(UserWarning, match="training-data"):
        assert set(entry_module.queries()) == set(QUERIES)
    with pytest.warns(UserWarning, match="training-data"):
        assert set(entry_module.oracle_sql()) == set(ORACLES)


def test_event_ledger_bounds_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    """The wide rows of a task do not grow with the table, whatever its splits are."""
    from sealtrail.plans import inputs
    from sealtrail.sources import splits

    monkeypatch.setattr(splits, "ROWS_PER_TASK", 50)
    events = spark.range(2000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type",
        "1.5D AS value", "'{}' AS props",
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    ledger = inputs.event_ledger(spark, str(tmp_path))
    sizes = [r["count"] for r in ledger.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 51
