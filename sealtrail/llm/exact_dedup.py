"""Exact duplicates: frequent digests are settled by a broadcast, all others by a shuffle.

Misra-Gries counters over the digests of each partition, merged, name every
digest with more than 1 / (COUNTERS + 1) of all rows.  Exact counts and winners of
those few are small by construction, so they are broadcast and their rows
never shuffle.  The other digests are aggregated and joined as usual.

Defined results: a null text is an empty text.  Equal means equal after
lower-casing A-Z.  The largest doc_id stays, null being smallest; of rows
repeated with the same id one stays.  No rows give no rows.  Further columns of
the input are not read by ``mark_copies`` and kept by ``without_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtrail.llm.common import free_name, slices, stored

# A digest with more than 1 / (COUNTERS + 1) of all rows is certain to be found.
COUNTERS = 1024


def _digests(texts: pa.Array) -> pa.Array:
    binary = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    return pa.array([hashlib.sha256(x.as_buffer().to_pybytes().lower()).digest() for x in binary], pa.binary())


def with_digest(docs: DataFrame, text: str = "text", name: str = "_digest") -> DataFrame:
    """Add the SHA-256 of the normalised text; ``bytes.lower`` changes A-Z only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            digests = _digests(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries counters of one partition; a batch is counted before it is merged."""
    held: dict[bytes, int] = {}
    for batch in batches:
        for pair in pc.value_counts(batch.column(0)):
            key = pair["values"].as_py()
            held[key] = held.get(key, 0) + pair["counts"].as_py()
        if len(held) > COUNTERS:
            least = sorted(held.values(), reverse=True)[COUNTERS]
            held = {k: n - least for k, n in held.items() if n > least}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["_digest", "n"]
    )


def frequent(keys: DataFrame) -> DataFrame:
    """At most COUNTERS digests, among them all with over 1 / (COUNTERS + 1) of the rows.

    Merging sums the counters of a digest and takes the (COUNTERS + 1)th largest
    from each; what is left at zero goes.
    """
    merged = (
        keys.select("_digest").mapInArrow(_summaries, "_digest binary, n long")
        .groupBy("_digest").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "_digest").limit(COUNTERS + 1)
    )
    rows = merged.collect()
    least = rows[COUNTERS]["n"] if len(rows) > COUNTERS else 0
    held = [(bytes(r["_digest"]),) for r in rows if r["n"] > least]
    return keys.sparkSession.createDataFrame(held, "_digest binary")


def _winners(keys: DataFrame) -> DataFrame:
    return keys.groupBy("_digest").agg(F.max("_rank").alias("_best"), F.count("*").alias("group_size"))


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The written table fixes the numbers that tell repeated rows apart.
    keys = stored(
        with_digest(narrow).select("doc_id", "_digest", F.monotonically_increasing_id().alias("_row"))
    ).withColumn("_rank", F.struct("doc_id", "_row"))
    heavy = F.broadcast(frequent(keys))
    settled = F.broadcast(_winners(keys.join(heavy, "_digest", "left_semi")))
    rest = keys.join(heavy, "_digest", "left_anti")
    marked = keys.join(settled, "_digest").unionByName(rest.join(_winners(rest), "_digest"))
    return marked.select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Digests and row numbers are written once, beside the rows.  Copies of a frequent
    digest go map-side, by its broadcast winner.  Of the others only keys meet; the
    numbers of the rows that go are then taken from the rows, so Spark sends them to all
    tasks if their list is small and shuffles only if it is not.
    """
    digest, row = free_name(docs, "_digest"), free_name(docs, "_row")
    rows = stored(with_digest(docs, text, digest).withColumn(row, F.monotonically_increasing_id()))
    keys = rows.select(F.struct(F.col(doc_id).alias("doc_id"), F.col(row).alias("_row")).alias("_rank"), F.col(digest).alias("_digest"))
    heavy = F.broadcast(frequent(keys))
    settled = _winners(keys.join(heavy, "_digest", "left_semi")).select("_digest", F.col("_best._row").alias("_best"))
    settled = F.broadcast(stored(settled).toDF("_heavy", "_best"))
    rest = keys.join(heavy, "_digest", "left_anti")
    several = _winners(rest).where("group_size > 1")
    gone = rest.join(several, "_digest").where(F.col("_rank._row") != F.col("_best._row")).select(F.col("_rank._row").alias("_gone"))
    left = rows.join(settled, rows[digest] == F.col("_heavy"), "left")
    left = left.where(F.col("_best").isNull() | (F.col("_best") == rows[row]))
    gone = stored(gone)
    return left.join(gone, left[row] == gone["_gone"], "left_anti").select(*[rows[c] for c in docs.columns])
