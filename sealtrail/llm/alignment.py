"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenise a space and the text.  Per batch, ``merge_asof`` keyed by document finds
the token of the other side that covers each token's start; the union of both
directions is all pairs of tokens that overlap.  Of these, the pairs that end at the
same byte are links, and their ends cut the document into groups.

A very long document is matched in windows that end where tokens of both sides do,
so no pair is in two windows and a frame stays small.

Linked tokens end together, so the bytes of one are a suffix of the other's, and a
token can be linked with at most as many byte strings as it has bytes.  So the pairs of
ids, which are counted over the whole corpus and then broadcast, are bounded by
the bytes of the two vocabularies, whatever the corpus.

Defined results: null and empty texts, and texts that one side does not give back byte
by byte, have no tokens: zeros and an empty digest.  Special strings in a text are
plain text.  Every row is aligned by itself, also with a null or repeated id, and counts
in the corpus.  An empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.bpe import _Kept, load
from sealtrail.llm.common import slices, stored

# Bytes of text whose tokens are matched in one frame.
WINDOW = 1 << 20
# Fixed: how the piece format writes a space, and a single byte.
SPACE = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# A space between other characters: no piece has a space behind another character.
BORDER = re.compile(rf"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
ODD_SPACES = re.compile(rf"^ | $|  |{SPACE}")


class Pieces:
    """Ids of a piece vocabulary, word by word, and their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = []
        for name in names:
            single = BYTE.fullmatch(name)
            self.bytes_of.append(bytes([int(single[1], 16)]) if single else name.replace(SPACE, " ").encode("utf-8"))
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.by_word = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.words = _Kept(lambda word: array("I", self.library.encode(word)).tobytes())

    def encode(self, text: str) -> np.ndarray:
        """Ids of a space and the text; the library itself puts the space before each part."""
        if not self.by_word:
            return np.array(self.library.encode(text), np.uint32)
        parts = BORDER.split(text) if ODD_SPACES.search(text) else text.split(" ")
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), np.uint32)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def overlapping(document: np.ndarray, start: np.ndarray, other_document: np.ndarray, other_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all overlapping tokens of two sides; each side is in order and leaves no byte out."""
    left = pd.DataFrame({"start": start, "document": document, "a": np.arange(len(start))})
    right = pd.DataFrame({"start": other_start, "document": other_document, "b": np.arange(len(other_start))})
    forth = pd.merge_asof(left, right, on="start", by="document")
    back = pd.merge_asof(right, left, on="start", by="document")
    # A pair with equal starts is found in both directions.
    back = back[start[back["a"].to_numpy(np.int64)] != other_start]
    pairs = [side["a"].to_numpy(np.int64) << 32 | side["b"].to_numpy(np.int64) for side in (forth, back)]
    both = np.concatenate(pairs)
    both.sort(kind="stable")
    return both >> 32, both & 0xFFFFFFFF


class Document:
    """Tokens of one text on both sides; none if their bytes differ from the text's."""

    def __init__(self, text: str | None, bpe, other: Pieces):
        self.a = self.b = np.empty(0, np.int64)
        if text:
            data = b" " + text.encode("utf-8")
            a = np.frombuffer(bpe._encode_plain(" " + text), np.uint32).astype(np.int64)
            b = other.encode(text).astype(np.int64)
            if bpe.flat_bytes(a) == data and b"".join(map(other.bytes_of.__getitem__, b.tolist())) == data:
                self.a, self.b = a, b
        self.a_end = np.cumsum((bpe.starts[self.a + 1] - bpe.starts[self.a]).astype(np.int64))
        self.b_end = np.cumsum(other.lengths[self.b].astype(np.int64))
        # Overlapping pairs of token numbers, and those of them that end together.
        self.overlaps: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def windows(self, size: int) -> list[tuple[int, int, int, int]]:
        """Token ranges of both sides that end at the same byte, of about ``size`` bytes."""
        if not len(self.a):
            return []
        stops = [self.a_end[-1]]
        if stops[0] > size:
            common = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
            stops = np.unique(common[np.searchsorted(common, np.append(np.arange(size, stops[0], size), stops[0]))])
        a_stop, b_stop = (np.searchsorted(e, stops, "right").tolist() for e in (self.a_end, self.b_end))
        return list(zip([0, *a_stop], a_stop, [0, *b_stop], b_stop))


def match(documents: list[Document], size: int) -> None:
    """Find the overlaps and links of documents, in frames of about ``size`` bytes."""
    frame: list[tuple[Document, tuple[int, int, int, int]]] = []

    def flush() -> None:
        if not frame:
            return
        key, start, other_key, other_start, ends, other_ends = [], [], [], [], [], []
        at = 0
        for n, (d, (a0, a1, b0, b1)) in enumerate(frame):
            for e, first, last, keys, starts, stops in (
                (d.a_end, a0, a1, key, start, ends), (d.b_end, b0, b1, other_key, other_start, other_ends)
            ):
                base = e[first - 1] if first else 0
                stops.append(e[first:last] - base + at)
                starts.append(np.concatenate([[at], stops[-1][:-1]]))
                keys.append(np.full(last - first, n))
            at = int(ends[-1][-1])
        key, other_key = np.concatenate(key), np.concatenate(other_key)
        a, b = overlapping(key, np.concatenate(start), other_key, np.concatenate(other_start))
        linked = np.concatenate(ends)[a] == np.concatenate(other_ends)[b]
        stops = np.searchsorted(a, np.cumsum([a1 - a0 for _, (a0, a1, _, _) in frame]))
        first_a = first_b = first = 0
        for (d, (a0, a1, b0, b1)), stop in zip(frame, stops):
            pairs = np.stack([a[first:stop] - first_a + a0, b[first:stop] - first_b + b0], 1)
            d.overlaps.append(pairs)
            d.links.append(pairs[linked[first:stop]])
            first, first_a, first_b = stop, first_a + a1 - a0, first_b + b1 - b0
        frame.clear()

    held = 0
    for d in documents:
        for window in d.windows(size):
            frame.append((d, window))
            held += int(d.a_end[window[1] - 1] - (d.a_end[window[0] - 1] if window[0] else 0))
            if held >= size:
                flush()
                held = 0
    flush()


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty((0, 2), np.int64), *parts])


def _batches(batches: Iterator[pa.RecordBatch], vocabulary: str, model: str) -> Iterator[tuple[pa.RecordBatch, list[Document]]]:
    bpe, other = load(vocabulary, library=True), pieces(model)
    for batch in slices(batches, "text", WINDOW):
        documents = [Document(value.as_py(), bpe, other) for value in batch.column(1)]
        match(documents, WINDOW)
        yield batch, documents


def align(docs: DataFrame, vocabulary: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the ids and end bytes of both sides, overlaps and groups.

    ``overlaps`` has the token numbers of overlapping pairs; ``groups`` the numbers of the
    last tokens of each group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, documents in _batches(batches, vocabulary, model):
            columns = [pa.array([getattr(d, n) for d in documents], pa.list_(pa.int64())) for n in ("a", "b", "a_end", "b_end")]
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            for name in ("overlaps", "links"):
                pairs = [_joined(getattr(d, name)).tolist() for d in documents]
                columns.append(pa.array([[{"a": a, "b": b} for a, b in p] for p in pairs], pair))
            names = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "overlaps", "groups"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{n} array<long>" for n in ("a_ids", "b_ids", "a_ends", "b_ends"))
    return rows.mapInArrow(run, f"doc_id {kind}, {lists}, overlaps array<struct<a:long,b:long>>, groups array<struct<a:long,b:long>>")


@lru_cache(maxsize=1)
def _shown(a: int, b: int) -> list[str]:
    """Each id as it is shown inside a group, then as the last of its side; first the ids of A, then those of B."""
    return [f"{i}{mark}" for marks, n in ((",|", a), (",;", b)) for mark in marks for i in range(n)]


def _digest(d: Document, links: np.ndarray, a_size: int, b_size: int) -> str:
    """SHA-256 of the groups' ids, each group's A ids before its B ids."""
    if not len(links):
        return ""
    stops = np.concatenate([[[0, 0]], links + 1])
    tokens = np.empty(len(d.a) + len(d.b), np.int64)
    # A token stands behind all earlier ones of its side, and the other side's groups that come first.
    a_at = np.arange(len(d.a)) + np.repeat(stops[:-1, 1], np.diff(stops[:, 0]))
    b_at = np.arange(len(d.b)) + np.repeat(stops[1:, 0], np.diff(stops[:, 1]))
    tokens[a_at], tokens[b_at] = d.a, d.b + 2 * a_size
    tokens[a_at[links[:, 0]]] += a_size
    tokens[b_at[links[:, 1]]] += b_size
    shown, digest = _shown(a_size, b_size), hashlib.sha256()
    for first in range(0, len(tokens) - 1, 1 << 16):
        part = tokens[first : min(first + (1 << 16), len(tokens) - 1)]
        digest.update("".join(map(shown.__getitem__, part.tolist())).encode())
    digest.update(shown[tokens[-1]][:-1].encode())
    return digest.hexdigest()


DIGESTS = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string"


def linked(docs: DataFrame, vocabulary: str, model: str, doc_id: str, text: str) -> DataFrame:
    """Per document its figures, and its different linked ids with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = len(load(vocabulary, library=True).starts), len(pieces(model).bytes_of)
        for batch, documents in _batches(batches, vocabulary, model):
            figures: list[list] = [[] for _ in range(6)]
            ids: list[list] = [[] for _ in range(3)]
            for d in documents:
                links = _joined(d.links)
                pairs, times = np.unique(d.a[links[:, 0]] << 32 | d.b[links[:, 1]], return_counts=True)
                # A group ends where a link does, so there are as many of both.
                row = (len(d.a), len(d.b), len(links), len(links), sum(map(len, d.overlaps)), _digest(d, links, *sizes))
                for column, value in zip(figures, row):
                    column.append(value)
                for column, value in zip(ids, (pairs >> 32, pairs & 0xFFFFFFFF, times)):
                    column.append(value.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in figures[:5]] + [pa.array(figures[5], pa.string())]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in ids]
            names = ["doc_id", *(c.split()[0] for c in DIGESTS.split(", ")), "_a", "_b", "_n"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {DIGESTS}, _a array<int>, _b array<int>, _n array<int>")


def _flat(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).flatten().to_numpy().astype(np.int64) for n in names]


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n: how many links of the whole corpus join two ids; added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = _flat(batch, ("_a", "_b", "_n"))
            pairs, at = np.unique(a << 32 | b, return_inverse=True)
            total = np.bincount(at, n, len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(total)], ["a", "b", "n"]
            )

    parts = found.select("_a", "_b", "_n").mapInArrow(run, "a long, b long, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignment_digests(docs: DataFrame, vocabulary: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: sizes, groups digest, and its links weighed by the whole corpus."""
    found = stored(linked(docs, vocabulary, model, doc_id, text))
    counts = pair_counts(found).toPandas()
    best = counts.groupby("b")["n"].transform("max") if len(counts) else counts["n"]
    codes = counts["a"].to_numpy(np.int64) << 32 | counts["b"].to_numpy(np.int64)
    order = np.argsort(codes)
    # Bounded by the vocabularies.
    shared = docs.sparkSession.sparkContext.broadcast(
        (codes[order], counts["n"].to_numpy(np.int64)[order], (counts["n"] == best).to_numpy(bool)[order])
    )
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, top = shared.value
        for batch in batches:
            a, b, n = _flat(batch, ("_a", "_b", "_n"))
            at = np.searchsorted(codes, a << 32 | b)
            sums = []
            ends = np.cumsum([0, *pc.list_value_length(batch.column(batch.schema.get_field_index("_n"))).to_pylist()])
            for value in (n * top[at], n * count[at]):
                total = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *names)]
            yield pa.RecordBatch.from_arrays([*columns, *sums], ["doc_id", *names, "n_best", "count_sum"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, {DIGESTS}, n_best long, count_sum long")
