"""Sequences, similarity and structure lines against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sealtrail.functions import residue_arrays as A
from sealtrail.functions import sequence as Q
from sealtrail.operators import sequences, similarity
from sealtrail.sources import structure_files

RNG = random.Random(5)
SEQUENCES = ["", "A", "KKKKKKKKKKKKKK", "DDDDDDDDDDDDDD", "XBJOUZ", "abc", "MSKGEELFTGVV", "é漢😀K", "AÉK"]
SEQUENCES += ["".join(RNG.choices("ACDEFGHIKLMNPQRSTVWYX", k=RNG.randint(1, 400))) for _ in range(60)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(SEQUENCES)), "i int, sequence string").repartition(3)


def by_key(df):
    return {r.i: r for r in df.collect()}


def half_up(hundredths: int, n: int) -> int:
    return (2 * hundredths + n) // (2 * n)


def test_peptide_stats(table):
    got = by_key(sequences.peptide_stats(table, ("i",)))
    for i, s in enumerate(SEQUENCES):
        row = got[i]
        if not s:
            assert tuple(row)[1:] == (0, 0, 7.0, 0.0, 0, 0)
            continue
        n = len(s)
        charge = sum(s.count(a) for a in "KR") - sum(s.count(a) for a in "DE")
        sums = [
            sum(round(scale.get(a, 0) * 100) for a in s) for scale in (Q.HYDROPATHY, Q.HELIX, Q.SHEET)
        ]
        assert (row.length, row.mass) == (n, 110 * n - 18)
        assert row.pi == max(2, min(12, 7 + charge / 2))
        assert row.gravy == half_up(sums[0], n) / 100
        assert (row.helix, row.sheet) == (half_up(sums[1], n), half_up(sums[2], n))


def test_coefficient_sums_agree(table):
    got = by_key(sequences.coefficient_sums(table, "i"))
    for i, s in enumerate(SEQUENCES):
        if s:
            assert got[i].hydropathy_sum == sum(round(Q.HYDROPATHY.get(a, 0) * 100) for a in s)
            assert got[i].sheet_sum == sum(round(Q.SHEET.get(a, 0) * 100) for a in s)


def score(residue: str, at: int) -> float:
    base = next((v for letters, v in Q.CONFIDENCE_CLASSES if residue in letters), 60)
    return max(50, min(98, base + math.sin(at * 0.7) * 4 + (at % 7) * 0.5))


def test_confidence(table):
    rows = sequences.residue_confidence(table, ("i",)).collect()
    got = {(r.i, r.pos): r.value for r in rows}
    expected = {(i, p): score(c, p) for i, s in enumerate(SEQUENCES) for p, c in enumerate(s)}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    means = by_key(sequences.confidence_mean(table, ("i",)))
    for i, s in enumerate(SEQUENCES):
        mean = sum(score(c, p) for p, c in enumerate(s)) / len(s) if s else 0
        assert abs(means[i].mean - mean) < 1e-9
        assert means[i].mean_1 == math.floor(means[i].mean * 10 + 0.5) / 10


def test_flat_kernels_over_cut_batches(monkeypatch):
    """Every cut of a batch gives the rows that a plain loop gives, also for slices, nulls and long characters."""
    texts = [None, "", "ACDE", "é\U0001f600K", "", "W" * 300, None, "acx", "\U0001f600" * 40, "LLL"]
    column = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    plain = [[score(c, p) for p, c in enumerate(t or "")] for t in texts]
    for most in (1, 7, 64, 1 << 22):
        monkeypatch.setattr(A, "MOST_BYTES", most)
        pieces = list(A._pieces(iter([column, column.slice(0, 0)])))
        assert sum(len(p) for p in pieces) == len(texts)
        assert all(len(p) == 1 or (pc.sum(pc.binary_length(p)).as_py() or 0) <= most for p in pieces)
        flat, rows = [], []
        for piece in pieces:
            codes, lengths = A._codes(piece)
            flat.append(A._scores(codes, lengths))
            rows += list(lengths)
        assert rows == [len(p) for p in plain]
        assert np.allclose(np.concatenate(flat), [x for p in plain for x in p], atol=1e-9)


def test_confidence_of_repeated_nulls_and_long_rows(spark):
    texts = [None, "", "é\U0001f600K", "ACDEFGHIKLMNPQRSTVWY" * 5000, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, sequence string").coalesce(1)
    got = {r.i: r.mean for r in sequences.confidence_mean(rows, ("i",)).collect()}
    for i, text in enumerate(texts):
        scores = [score(c, p) for p, c in enumerate(text or "")]
        assert abs(got[i] - (sum(scores) / len(scores) if scores else 0)) < 1e-9
    counts = {r.i: r.n for r in sequences.residue_confidence(rows, ("i",)).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert counts == {2: 3, 3: 100_000}


def test_null_sequence(spark):
    row = sequences.confidence_mean(spark.sql("select 1 i, cast(null as string) sequence"), ("i",)).first()
    assert row.mean == 0.0


def test_positions(table):
    rows = sequences.residue_positions(table, ("i",)).collect()
    assert {(r.i, r.pos, r.residue) for r in rows} == {
        (i, p, c) for i, s in enumerate(SEQUENCES) for p, c in enumerate(s)
    }


def test_sanitize(spark):
    texts = [" msk-gee\n", "straße", "1234", "ﬁ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Q.sanitize_sequence(F.col("t")).alias("s"))
    kept = {r.t: r.s for r in df.collect()}
    alphabet = set(Q.RESIDUE_ALPHABET)
    assert kept == {t: "".join(c for c in t.strip().upper() if c in alphabet) for t in texts}


def test_similarity_maps(spark):
    rng = random.Random(2)
    vectors = {(g, p): [rng.uniform(-1, 1) for _ in range(8)] for g, n in (("a", 5), ("b", 70), ("c", 1)) for p in range(n)}
    vectors["a", 3] = [0.0] * 8
    rows = [(g, p * 10, v) for (g, p), v in vectors.items()]
    items = spark.createDataFrame(rows, "label string, vec_id long, embedding array<float>").repartition(4)
    pairs = {(r.label, r.i, r.j): r.value for r in similarity.cosine_pairs(items).collect()}
    assert len(pairs) == 25 + 64 * 64 + 1

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-9)

    for (g, i, j), value in pairs.items():
        assert abs(value - cosine(vectors[g, i], vectors[g, j])) < 1e-6
    scaled = {(r.label, r.i, r.j): r.value for r in similarity.minmax_scale(items).collect()}
    for g in "abc":
        values = [v for k, v in pairs.items() if k[0] == g]
        low, high = min(values), max(0, max(values))
        for k, v in pairs.items():
            if k[0] == g:
                assert abs(scaled[k] - (v - low) / (high - low + 1e-9)) < 1e-9


def test_all_negative_map_scales_from_zero(spark):
    import numpy as np

    values = similarity._scaled(np.array([[-0.5, -0.25]]))
    assert np.allclose(values, [[0.0, 0.5]])


def test_rank_limit_applies_before_the_shuffle(spark):
    items = spark.range(100).selectExpr("id % 2 label", "id vec_id", "array(1.0f, id) embedding")
    plan = similarity.cosine_pairs(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_structure_lines(spark, tmp_path):
    def line(record, atom, number):
        return f"{record:<6}{1:>5} {atom:^4}".ljust(60) + number.rjust(6)

    lines = [
        line("ATOM", "CA", "91.25"), line("ATOM", "N", "-1.5"), line("HETATM", "CA", "3.0"),
        line("ATOM", "CA", "n/a"), line("ATOM", "CA", "7.5x"), line("ATOM", "CA", "1.0")[:65],
        line("ATOM", "CA", "NaN"), line("ATOM", "CA", ""), line("ATOM", "CA", "1e2") + "  tail",
        "REMARK", "",
    ]
    for name in ("one", "two"):
        (tmp_path / f"{name}.pdb").write_text("\n".join(lines))
    read = structure_files.read_lines(spark, str(tmp_path))
    every = structure_files.fixed_width_atoms(read, ("file",)).collect()
    expected = [-1.5, 7.5, 91.25, 100.0]
    for name in ("one", "two"):
        assert sorted(r.confidence for r in every if r.file.endswith(f"{name}.pdb")) == expected
    named = structure_files.fixed_width_atoms(read, ("file",), atom_name="CA").collect()
    assert sorted(r.confidence for r in named) == [7.5, 7.5, 91.25, 91.25, 100.0, 100.0]


def test_chat_history(spark):
    turns = spark.createDataFrame(
        [(1, 0, "human", "a"), (1, 1, "agent", "b"), (1, 2, "human", "c"), (2, 5, "human", "x")],
        "conv_id int, turn int, role string, content string",
    )
    got = {(r.conv_id, r.turn): r.history for r in sequences.chat_history(turns).collect()}
    assert got == {(1, 0): "", (1, 2): "Human: a\nAI: b", (2, 5): ""}


def test_chunk_rows(spark):
    texts = spark.createDataFrame([(1, "aa\n\nbb\n\ncc"), (2, " "), (3, "zz")], "i int, text string")
    rows = sorted(tuple(r) for r in sequences.text_chunks(texts, ("i",), max_chars=6).collect())
    assert rows == [(1, 10, 2, 0, "aa\n\nbb"), (1, 10, 2, 1, "cc"), (3, 2, 1, 0, "zz")]


def test_history_over_blocks(spark):
    """One conversation with a third of all turns, and turns in few and in many blocks, against a plain loop."""
    rows = [("long", i, "human" if i % 3 else "agent", f"said {i}" if i % 7 else None) for i in range(100)]
    rows += [(None, i, "human", f"q{i}") for i in (1, 40, 10**12, 10**12 + 1)]
    rows += [(f"c{i}", t, "human", "") for i in range(30) for t in range(5)] + [("none", None, "human", "first"), ("none", 2, "human", "x")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, content string").repartition(7)
    expected = {}
    for conv, turn, role, content in rows:
        if role == "human":
            before = [r for r in rows if r[0] == conv and (-1 if r[1] is None else r[1]) < (-1 if turn is None else turn)]
            said = [("Human: " if r[2] == "human" else "AI: ") + r[3] for r in before if r[3] is not None]
            expected[conv, turn] = (content, "\n".join(said))
    for block in (1, 8, 64):
        got = sequences.chat_history(turns, block=block).collect()
        assert len(got) == len(expected)
        assert {(r.conv_id, r.turn): (r.message, r.history) for r in got} == expected


def test_history_of_many_blocks_without_the_driver(spark):
    """A conversation of 300 sparse turns: its texts move few times, and none is broadcast."""
    turns = spark.range(300).selectExpr(
        "1 AS conv_id", "id * 1000 AS turn", "IF(id % 2 = 0, 'human', 'agent') AS role", "'t' || id AS content"
    )
    told = sequences.chat_history(turns)
    got = {r.turn: r.history for r in told.collect()}
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    said = [("Human: " if i % 2 == 0 else "AI: ") + f"t{i}" for i in range(300)]
    assert got == {i * 1000: "\n".join(said[:i]) for i in range(0, 300, 2)}


def test_history_lengths_add_up(spark):
    """The length beside a history is that of the history, with wide characters, empty texts and turns without text."""
    texts = ["", None, "ab", "é\U0001f600", "a\nb"]
    rows = [("long", i, "human" if i % 3 else "agent", texts[i % 5]) for i in range(200)] + [("mute", i, "human", None) for i in range(150)]
    rows += [(None, 1, "human", "q"), ("one", None, "human", "é"), ("one", 4, "human", None), ("one", 5, "agent", "z")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, content string").repartition(3)
    for block in (1, 16, 64):
        got = sequences.chat_history(turns, block=block, chars="chars").collect()
        assert len(got) == sum(r[2] == "human" for r in rows)
        assert all(r.chars == len(r.history) for r in got)


def test_history_tasks_are_alike(spark):
    """A conversation's late runs have most of the text before them, yet no task gets two of them."""
    turns = spark.range(3200).selectExpr("1 AS conv_id", "id AS turn", "'human' AS role", "'said' AS content")
    told = sequences.chat_history(turns, block=10).selectExpr("spark_partition_id() AS task", "length(history) AS n")
    load = [r.n for r in told.groupBy("task").sum("n").toDF("task", "n").collect()]
    assert max(load) < 0.08 * sum(load)


def test_maps_take_every_vector(spark):
    ids = [None] * 70 + [3] * 90 + list(range(100, 140))
    rows = [(i, [float(n % 9), 1.0]) for n, i in enumerate(ids)]
    items = similarity.in_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    places = sorted((r.place, r.sequence) for r in items.collect())
    assert places == [(i, i // 64) for i in range(200)]
    cells = similarity.cosine_pairs(items, group="sequence", position="place").groupBy("sequence").count().collect()
    assert {r["sequence"]: r["count"] for r in cells} == {0: 4096, 1: 4096, 2: 4096, 3: 64}
    assert items.orderBy("place").first().vec_id == 3 and items.where("place > 129 and vec_id is not null").count() == 0
