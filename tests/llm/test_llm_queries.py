"""The registered queries, and the pipeline against its stages done plainly."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from sealtrail.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.test_texts import brute_components, lowered
from tests.test_queries import SF_DIR, TABLES, values

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not found")


def test_registered():
    names = [re.match(r"op(\d+)_", n)[1] for n in LLM_QUERIES]
    assert sorted(map(int, names)) == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secrets", "packing"]


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    result = LLM_QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(LLM_ORACLES[name])
    assert values(result.columns, [tuple(r) for r in result.collect()]) == values(
        [d[0] for d in cursor.description], cursor.fetchall()
    )


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_near_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    expected, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in LLM_QUERIES["op4_near_dedup"](spark, SF_DIR).collect()} == expected


def test_classifiers_on_held_out_rows(spark):
    found = LLM_QUERIES["op10_language_id"](spark, SF_DIR).join(documents(spark), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.9
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = LLM_QUERIES["op8_quality"](spark, SF_DIR)
    held = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.75
    assert scored.count() == documents(spark).count()
    for r in scored.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF_DIR)
    assert known.columns == docs.columns
    left = {r.doc_id: r.text for r in known.collect()}
    assert set(left) == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    best = {}
    for i, text in left.items():
        best[lowered(text)] = max(i, best.get(lowered(text), i))
    left = {i: left[i] for i in best.values()}
    component, _ = brute_components(list(left.items()))
    left = {i for i in left if component[i] == i}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == left
    bins = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
