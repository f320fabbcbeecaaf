"""Token counts, with huge documents encoded in overlapping chunks and spliced.

A document above ``chunk`` bytes becomes rows of one chunk each, every chunk
reaching ``overlap`` bytes into the next one, so that one huge document is
spread over tasks.  Each chunk is encoded with the byte offsets of its tokens.
Two neighbours are spliced behind a token that both have at the same bytes.

Such a place is proven stable.  Words of the split (runs of letters, of digits,
of other signs, of white space) end at the same byte whatever stands before
them, and tokens are the exact merges of a word if and only if every two
neighbours among them are.  The left chunk's tokens up to the common one are
right by induction from the document's start; the right chunk's tokens from
the common one on have all their neighbours in the same encoding.  Tokens
nearer to a chunk's cut end than the longest special string do not count.

Where two neighbours have no token in common, as inside a very long run of one
letter, the overlap is widened over the whole right chunk: both become one chunk,
which is encoded anew.  That repeats until every neighbour is spliced.

Defined results: null and empty texts have 0 bytes and 0 tokens.  Every row
counts by itself, also with a null or repeated id.  An empty table gives no rows.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealtrail.llm.bpe import Bpe, load
from sealtrail.llm.common import slices, stored

CHUNK = 1 << 16
OVERLAP = 1 << 10
LIMIT = 1024
# Chunks in one task.
TOGETHER = 64

# Fixed: what the split cuts off after an apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def check_vocabulary(bpe: Bpe) -> int:
    """The margin at a chunk's cut ends, in bytes; an error if splicing has no proof for the vocabulary.

    A contraction has to be one token, or its last letters could be taken for
    a word's; special strings must not overlap, or which of them counts would
    depend on what stands before.
    """
    if any(len(bpe.encode(c)) != 4 for c in CONTRACTIONS):
        raise ValueError("each contraction has to be a single token")
    special = list(bpe.specials)
    for a in special:
        for b in special:
            if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("special strings that overlap each other")
    return max([4, *(len(s.encode()) for s in special)])


def _cut(data: bytes, at: int) -> int:
    """The start of the character at a byte."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(docs: DataFrame, vocabulary: str, chunk: int, overlap: int, doc_id: str, text: str) -> DataFrame:
    """Counts of documents of one chunk; rows of one chunk for each of the others.

    ``_own`` is the chunk up to the next one, ``_tail`` what it has in common with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = load(vocabulary, library=True), TaskContext.get().partitionId() << 33

        def made(source: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, n_bytes, n_tokens, row, no, last, own, tail = zip(*rows)
            columns = [source.take(pa.array(at, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, row)]
            columns += [pa.array(no, pa.int32()), pa.array(last, pa.bool_())]
            columns += [pa.array(x, pa.string()) for x in (own, tail)]
            names = ["doc_id", "n_bytes", "n_tokens", "_row", "_no", "_last", "_own", "_tail"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            held = 0
            for i, value in enumerate(batch.column(1)):
                value = value.as_py() or ""
                data = value.encode("utf-8")
                if len(data) <= chunk + overlap:
                    rows.append((i, len(data), len(bpe.encode(value)) // 4, None, None, None, None, None))
                    continue
                seen += 1
                begin, no = 0, 0
                while begin < len(data):
                    # What is left over of at most an overlap joins the last chunk.
                    end = _cut(data, begin + chunk) if len(data) - begin > chunk + overlap else len(data)
                    own = data[begin:end].decode("utf-8")
                    tail = data[end : _cut(data, end + overlap)].decode("utf-8")
                    rows.append((i, len(data), None, seen, no, end == len(data), own, tail))
                    held += end - begin
                    begin, no = end, no + 1
                    if held > 1 << 22:
                        yield made(batch.column(0), rows)
                        rows, held = [], 0
            if rows:
                yield made(batch.column(0), rows)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, n_tokens long, _row long, _no int, _last boolean, _own string, _tail string",
    )


def encoded(chunks: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """Per chunk its number of tokens, and the tokens at both borders.

    A token at a border is one number: its start and its end in bytes from the
    border.  ``left_at`` and ``right_at`` are the chunk's tokens before the first listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, library=True)
        margin = check_vocabulary(bpe)
        sizes = np.diff(bpe.starts)
        for batch in batches:
            count, left, left_at, right, right_at = [], [], [], [], []
            for own, tail, no in zip(*(batch.column(i).to_pylist() for i in (3, 4, 1))):
                ids = np.frombuffer(bpe.encode(own + tail), np.uint32)
                ends = np.cumsum(sizes[ids], dtype=np.int64)
                starts = ends - sizes[ids]
                count.append(len(ids))
                first, last = np.searchsorted(starts, margin), np.searchsorted(ends, overlap, "right")
                left.append(starts[first:last] << 32 | ends[first:last] if no else starts[:0])
                left_at.append(int(first))
                border = len(own.encode("utf-8"))
                first = np.searchsorted(starts, border)
                last = np.searchsorted(ends, ends[-1] - margin, "right") if len(ends) else 0
                right.append(starts[first:last] - border << 32 | ends[first:last] - border if tail else starts[:0])
                right_at.append(int(first))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in (0, 1, 2, 5, 6)),
                    pa.array(count, pa.int64()),
                    pa.array(left, pa.list_(pa.int64())), pa.array(left_at, pa.int64()),
                    pa.array(right, pa.list_(pa.int64())), pa.array(right_at, pa.int64()),
                ],
                ["_row", "_no", "_last", "doc_id", "n_bytes", "n", "left", "left_at", "right", "right_at"],
            )

    rows = chunks.select("_row", "_no", "_last", "_own", "_tail", "doc_id", "n_bytes")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"_row long, _no int, _last boolean, doc_id {kind}, n_bytes long, n long, "
        "left array<long>, left_at long, right array<long>, right_at long",
    )


def spliced(chunks: DataFrame) -> DataFrame:
    """Per border of two chunks: how far the left chunk's count of tokens is ahead of the right one's.

    Null where they have no token in common.
    """
    before = chunks.where("not _last").select(
        "_row", (F.col("_no") + 1).cast("int").alias("_no"), "right", "right_at"
    )
    both = chunks.where("_no > 0").select("_row", "_no", "left", "left_at").join(before, ["_row", "_no"])
    shared = F.array_intersect("right", "left")
    both = both.withColumn("shared", F.when(F.size(shared) > 0, shared[0]))
    return both.select(
        "_row",
        "_no",
        (
            F.col("right_at") + F.array_position("right", F.col("shared"))
            - F.col("left_at") - F.array_position("left", F.col("shared"))
        ).alias("ahead"),
    )


def widened(chunks: DataFrame, borders: DataFrame) -> DataFrame:
    """Chunks of the documents with a border that failed, joined over those borders.

    The window runs over small rows, one per chunk of a document.
    """
    failed = borders.where("ahead is null").select("_row").distinct()
    order = Window.partitionBy("_row").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    numbers = borders.withColumn("_to", F.count("ahead").over(order).cast("int")).select("_row", "_no", "_to")
    rows = chunks.join(failed, "_row").join(numbers, ["_row", "_no"], "left")
    parts = F.sort_array(F.collect_list(F.struct("_no", "_own", "_tail", "_last")))
    return (
        rows.groupBy("_row", F.coalesce("_to", F.lit(0)).alias("_to"))
        .agg(parts.alias("parts"), F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"))
        .select(
            "doc_id", "n_bytes", "_row", F.col("_to").alias("_no"),
            F.element_at("parts", -1)["_last"].alias("_last"),
            F.array_join(F.col("parts")["_own"], "").alias("_own"),
            F.element_at("parts", -1)["_tail"].alias("_tail"),
        )
    )


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    if not 8 <= overlap <= chunk // 2:
        raise ValueError("the overlap is at least 8 bytes and at most half a chunk")
    cut = stored(chunked(docs, vocabulary, chunk, overlap, doc_id, text))
    counts = [cut.where("_no is null").select("doc_id", "n_bytes", "n_tokens")]
    chunks = cut.where("_no is not null")
    while many := chunks.count():
        spread = chunks.repartition(-(-many // TOGETHER), "_row", "_no")
        known = stored(encoded(spread, vocabulary, overlap))
        borders = stored(spliced(known))
        sums = borders.groupBy("_row").agg(F.sum("ahead").alias("ahead"), F.count_if(F.isnull("ahead")).alias("open"))
        last = known.where("_last").select("_row", "doc_id", "n_bytes", "n").join(sums, "_row", "left")
        total = (F.col("n") + F.coalesce("ahead", F.lit(0))).alias("n_tokens")
        counts.append(last.where("coalesce(open, 0) = 0").select("doc_id", "n_bytes", total))
        if borders.where("ahead is null").isEmpty():
            break
        chunks = stored(widened(chunks, borders))
    whole = reduce(DataFrame.unionByName, counts)
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
