"""Token counts, centroid clusters and tokenizer alignment against their plain forms."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sealtrail.llm import alignment, centroids, token_counts
from sealtrail.llm.bpe import load
from sealtrail.llm.queries import vocabulary

VOCABULARY, MODEL = vocabulary(), vocabulary("piece_bpe_32k.model")
BITS = [
    "'s", "'ll", "'", "s", "word", "sword", " ", "  ", "\n", "\t", "!", "!!", "é", "日本", "語", "123", "4", "<|endoftext|>", "<|",
    "endoftext", "|>", "<s>", "<0x41>", "a" * 30, " " * 25, "\n\n", "x", "ing", "tion", "😀", " ", "'ve", "re", "\x00",
]


def odd_texts(seed, count, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(count)]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(VOCABULARY)


# --- token counts ---------------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (200, 64)])
def test_token_counts(spark, chunk, overlap):
    """Chunks far smaller than in use, so that most texts are spliced, and long runs need wider overlaps."""
    texts = odd_texts(1, 150, 300) + [None, "", "a" * 3000, " " * 3000, "ab" * 2000, "日" * 1500, "!'" * 900, "<|endoftext|>" * 100]
    texts += [x + "a" * 700 + y for x, y in zip(odd_texts(2, 5, 200), odd_texts(3, 5, 200))]
    rows = [(i, x, 7, "own") for i, x in enumerate(texts)] + [(None, "null id " * 50, 1, ""), (3, texts[3], 1, ""), (3, texts[4], 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _own string").repartition(5)
    tokens = library()
    expected = Counter()
    for i, x, _, _ in rows:
        n = len(tokens.encode(x or "", add_special_tokens=False).ids)
        expected[i, len((x or "").encode()), n, n > 100] += 1
    found = token_counts.count_tokens(docs, VOCABULARY, limit=100, chunk=chunk, overlap=overlap)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_overlaps_are_widened(spark):
    text = "word " * 30 + "a" * 500 + " word" * 30
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = token_counts.chunked(docs, VOCABULARY, 100, 40, "doc_id", "text")
    chunks = [r for r in cut.orderBy("_no").collect()]
    assert "".join(r._own for r in chunks) == text and all(a._tail == b._own[:40] for a, b in zip(chunks, chunks[1:]) if len(b._own) >= 40)
    borders = token_counts.spliced(token_counts.encoded(cut, VOCABULARY, 40))
    failed = borders.where("ahead is null").count()
    assert 0 < failed < len(chunks) - 1
    wider = token_counts.widened(cut, borders).orderBy("_no").collect()
    assert len(wider) == len(chunks) - failed and "".join(r._own for r in wider) == text
    assert [r._last for r in wider] == [False] * (len(wider) - 1) + [True]


def test_no_documents_to_count(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, chunk=10, overlap=8)


# --- clusters -------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dimensions):
    kept = [
        (i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [
            tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if n in groups else c for n, c in enumerate(centres)
        ]
    placed = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, n, d in placed:
        inertia[n] += d
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), shown[n]) for i, n, d in placed)


SCHEMA = "vec_id long, embedding array<float>, cluster string"


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters(spark, bits):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    x[:150] = x[0]
    x[200:300] += 3
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (9, [-2.0] * 6)]
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [None] + [1.0] * 5), (504, [float("nan")] * 6), (505, [float("-inf")] + [1.0] * 5)]
    table = spark.createDataFrame([(i, v, "c") for i, v in rows + odd], SCHEMA).repartition(4)
    found = centroids.cluster(table, centroids=5, rounds=6, bits=bits, dimensions=6)
    assert found.columns[:3] == ["vec_id", "cluster", "distance"]
    assert Counter(tuple(r) for r in found.collect()) == plain_clusters(rows + odd, 5, 6, 6)


def test_few_vectors_to_cluster(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).collect() == []
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    found = centroids.cluster(table, dimensions=2)
    assert Counter(tuple(r) for r in found.collect()) == plain_clusters(rows, 8, 10, 2)


def test_fetches_only_where_intervals_overlap(spark):
    """Intervals hold the distances, decide only what is sure, and leave well-parted vectors alone."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-40, 40, (300, 8)) + 900 * k for k in range(4)])
    centres = np.array([x[300 * k : 300 * (k + 1)].mean(0).astype(np.int64) for k in range(4)])
    for bits in (3, 8):
        grid = centroids.Grid(x.min(0), x.max(0), bits)
        cells, far = grid.cell(x), centroids.distances(x, centres)
        mean = centres.sum(0) // 4
        shifted = far - ((x - mean) ** 2).sum(1)[:, None]
        sums = sum(grid.tables(centres)[d][cells[:, d]] for d in range(8))
        assert (sums[:, :4] <= shifted).all() and (shifted <= sums[:, 4:]).all()
        sure = centroids.decided(cells, grid.tables(centres))
        assert ((sure == -1) | (sure == far.argmin(1))).all()
    full = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "_row long, vec_id long, vector array<int>")
    shares = []
    centroids.fit(full, centres + 5, 5, 8, shares)
    assert shares and max(shares) < len(x) / 10


# --- alignment ------------------------------------------------------------------------


def plain_alignment(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokens, pieces = library(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokens.encode_special_tokens = True
    bpe = load(VOCABULARY)
    documents, counts = [], Counter()
    for text in texts:
        documents.append(([], [], []))
        if not text:
            continue
        a, b = tokens.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bpe.flat_bytes(np.array([i])) for i in a]
        b_bytes = []
        for i in b:
            name = pieces.id_to_piece(i)
            single = re.fullmatch("<0x(..)>", name)
            b_bytes.append(bytes([int(single[1], 16)]) if single else name.replace("▁", " ").encode())
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        at = {end: j for j, end in enumerate(ends[1])}
        links = [(i, at[end]) for i, end in enumerate(ends[0]) if end in at]
        counts.update((a[i], b[j]) for i, j in links)
        documents[-1] = (a, b, links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, links in documents:
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        linked = [counts[a[i], b[j]] for i, j in links]
        top = sum(n == best[b[j]] for n, (_, j) in zip(linked, links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), top, sum(linked), digest))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark):
    texts = odd_texts(8, 200, 120) + [None, "", " ", "  ", "▁", "a ▁b", "a" * 2000, " " * 2000, "ab " * 1500, "日" * 1000]
    texts += texts[:3]
    ids = [None if i % 50 == 1 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, x, "a", 1) for i, x in zip(ids, texts)], "doc_id long, text string, n_a string, _a int").repartition(4)
    found = alignment.alignment_digests(docs, VOCABULARY, MODEL)
    got = Counter((r.doc_id, *(r[c] for c in ALIGNED)) for r in found.collect())
    assert got == Counter((i, *x) for i, x in zip(ids, plain_alignment(texts)))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digests(none, VOCABULARY, MODEL).count() == 0


def test_overlaps_and_windows(spark):
    """All overlapping pairs, also where a document is matched window by window."""
    bpe, pieces = load(VOCABULARY, library=True), alignment.pieces(MODEL)
    texts = odd_texts(9, 60, 80)
    documents = [alignment.Document(x, bpe, pieces) for x in texts]
    alignment.match(documents, 100)
    for d in documents:
        a_start, b_start = np.append(0, d.a_end[:-1]), np.append(0, d.b_end[:-1])
        pairs = {
            (i, j) for i in range(len(d.a)) for j in range(len(d.b)) if a_start[i] < d.b_end[j] and b_start[j] < d.a_end[i]
        }
        assert {tuple(p) for p in alignment._joined(d.overlaps).tolist()} == pairs
        links = {(i, j) for i, j in pairs if d.a_end[i] == d.b_end[j]}
        assert {tuple(p) for p in alignment._joined(d.links).tolist()} == links
    assert any(len(d.overlaps) > 1 for d in documents)
    docs = spark.createDataFrame(list(enumerate(texts[:5])), "doc_id long, text string")
    for r in alignment.align(docs, VOCABULARY, MODEL).collect():
        d = alignment.Document(texts[r.doc_id], bpe, pieces)
        alignment.match([d], 1 << 20)
        assert r.a_ids == d.a.tolist() and r.b_ends == d.b_end.tolist()
        assert [(g.a, g.b) for g in r.groups] == [tuple(p) for p in alignment._joined(d.links).tolist()]
        assert len(r.overlaps) == len(alignment._joined(d.overlaps))
