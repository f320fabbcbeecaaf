"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by offsets.

An Aho-Corasick automaton gives the longest token at every position of a piece.
The encoder takes it if it may stand after the token before: a pair of tokens is
compatible if merging their joined bytes gives the pair back.  If not, it tries
the next shorter token, and where none fits it takes back the token before and
never returns to that position.  So each position is left once at most.

Texts are cut at single spaces between other characters, which is always a
border between pieces; what such a part encodes to is kept for the next time.

Defined results: null and empty texts have no tokens.  Text of any length is
encoded whole; the kept parts are bounded in number and length.  A special
token's string in a text becomes that token, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: the split of the byte-level format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# How many parts a worker keeps, and the longest one kept.
KEPT_PARTS = 1 << 18
KEPT_LENGTH = 40
# The longest white-space run that the library gets.
LIBRARY_SPACES = 100_000


def _printable() -> dict[str, int]:
    """The format's letter for each byte: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Kept(dict):
    """Parts already encoded, in two generations of bounded size.

    When the young one is full it becomes the old one; a part found there moves
    back, so frequent parts stay.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        made = self.old.get(part)
        if made is None:
            made = self.make(part)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = made
        return made


class _Pairs(dict):
    """The pair-compatibility table, filled as pairs are met; left << 32 | right to a truth value."""

    def __init__(self, compatible):
        super().__init__()
        self.compatible = compatible

    def __missing__(self, pair: int) -> bool:
        fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[pair] = fits
        return fits


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _printable()
        vocab = spec["model"]["vocab"]
        raw = {name: bytes(letters[c] for c in name) for name in vocab}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # Tokens are numbered by merge rank here; ``ids`` turns that into the vocabulary's ids.
        singles = sorted((n for n in vocab if len(raw[n]) == 1), key=vocab.get)
        rank = {name: i for i, name in enumerate(singles)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(singles))]
        names = list(singles)
        for left, right in merges:
            if left + right not in rank:
                rank[left + right] = len(names)
                names.append(left + right)
                self.halves.append((rank[left], rank[right]))
            self.pairs.setdefault((rank[left], rank[right]), rank[left + right])
        self.bytes_of = [raw[n] for n in names]
        self.lengths = [len(b) for b in self.bytes_of]
        self.ids = [vocab[n] for n in names]
        self.automaton = ahocorasick.Automaton()
        # What the automaton has read, to the longest token that begins it.
        self.longest: dict[str, int] = {}
        for i in sorted(range(len(names)), key=self.lengths.__getitem__):
            word = self.bytes_of[i].decode("latin-1")
            self.automaton.add_word(word, i)
            before = self.longest.get(word[:1], i)
            for n in range(1, len(word)):
                before = self.longest.setdefault(word[:n], before)
            self.longest[word] = i
        self.automaton.make_automaton()
        self.most = max(self.lengths)
        by_bytes = {b: i for i, b in enumerate(self.bytes_of)}
        self.shorter = [
            next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1) for b in self.bytes_of
        ]
        self.fits = _Pairs(self.compatible)
        self.split = regex.compile(PIECES).findall
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.pieces = _Kept(self._encode_piece)
        self.first = _Kept(self._encode_part)
        self.spaced = _Kept(lambda part: self._encode_part(" " + part))
        self._offset_table(vocab, raw)

    def _offset_table(self, vocab: dict[str, int], raw: dict[str, bytes]) -> None:
        """All tokens' bytes in one array, and where each id's bytes start."""
        table = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for name, i in vocab.items():
            table[i] = raw[name]
        for content, i in self.specials.items():
            table[i] = content.encode()
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in table])])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the same two tokens.

        Undoes the later of the two tokens' last merges, again and again; a pair
        across the border that merges earlier than what was undone rules it out.
        """
        most = len(self.halves) + 1
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < most:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    most, half = left, self.halves[left][1]
                    if half != left:
                        left = half
                        break
                else:
                    most, half = right + 1, self.halves[right][0]
                    if half != right:
                        right = half
                        break
                undo_left = not undo_left
            else:
                return True

    def tokens(self, piece: bytes) -> list[int]:
        """Tokens of one piece, by merge rank."""
        sizes, fits, text = self.lengths, self.fits, piece.decode("latin-1")
        walk, longest, most = self.automaton.longest_prefix, self.longest, self.most
        out: list[int] = []
        closed: set[int] = set()
        at, last, size = 0, -1, len(piece)
        token = longest[text[: walk(text[:most])]] if size else -1
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if end not in closed and (last < 0 or fits[last << 32 | token]):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at = end
                if at < size:
                    ahead = text[at : at + most]
                    token = longest[ahead[: walk(ahead)]]
            else:
                closed.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", map(self.ids.__getitem__, self.tokens(piece.encode("utf-8")))).tobytes()

    def _encode_part(self, part: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(part)))

    def _encode_plain(self, text: str) -> bytes:
        if _SPACES.search(text):
            first, *rest = _BORDER.split(text)
        else:
            first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.special is None or not any(s in text for s in self.specials):
            return self._encode_plain(text)
        return b"".join(
            np.uint32(self.specials[x]).tobytes() if x in self.specials else self._encode_plain(x)
            for x in self.special.split(text)
            if x
        )

    def flat_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, with specials."""
        if not len(ids):
            return b""
        first, sizes = self.starts[ids], self.starts[ids.astype(np.int64) + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[places].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, with specials; bytes that are no UTF-8 are replaced."""
        return self.flat_bytes(ids).decode("utf-8", "replace")


class LibraryBpe(Bpe):
    """The same ids, with new parts encoded by the tiktoken library from the same vocabulary.

    The library's split keeps a step of its stack, of a million at most, for each
    character of a white-space run, and fails above; parts with long runs are
    encoded as in the base class.
    """

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes_of)}
        self.library = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _encode_part(self, part: str) -> bytes:
        if len(part) > LIBRARY_SPACES and any(m.end() - m.start() > LIBRARY_SPACES for m in _SPACE_RUN.finditer(part)):
            return super()._encode_part(part)
        return array("I", map(self.ids.__getitem__, self.library.encode_ordinary(part))).tobytes()


# A space next to other white space: there a plain split could cut inside a piece.
_SPACES = re.compile(r" \s|\s ")
_SPACE_RUN = re.compile(r"\s+")
_BORDER = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def load(path: str, library: bool = False) -> Bpe:
    """One encoder per worker and vocabulary."""
    return LibraryBpe(path) if library else Bpe(path)


def tokenise(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, its ids, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(x), np.uint32) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            texts = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    As ``tokenise``, but ids and texts stay in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        shown = [str(i) for i in range(len(bpe.starts))]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = np.frombuffer(bpe.encode(value.as_py()), np.uint32)
                counts.append(len(ids))
                listed = ",".join(map(shown.__getitem__, ids.tolist()))
                ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

