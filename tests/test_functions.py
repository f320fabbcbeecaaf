"""Column functions against plain Python and fixed vectors."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sealtrail.functions import hashing as H
from sealtrail.functions import json_text as J
from sealtrail.functions import rules as R
from sealtrail.functions import text as X
from tests import by_hand

TEXTS = [
    "",
    "plain",
    'quote " and \\ backslash',
    "line\nbreak\ttab\r\b\f",
    "nul\x00 unit\x1f vt\x0b esc\x1b del\x7f",
    "\x0b\x0b\x1a\x1b\x1c\x1d\x1e\x0e\x0f",
    "literal \\u000B stays",
    "literal \\\\u001F stays \x1f",
    "grüße é   😀 </script>",
]


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression.alias("out"))
    return [r.out for r in sorted(df.collect())]


def test_hash_chain(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t",
        H.payload_hash(F.col("t")).alias("h"),
        H.key_bound_root(F.col("t"), F.lit("key")).alias("r"),
        H.leaf_hash(F.col("t"), F.lit("root")).alias("l"),
        H.merkle_parent(F.col("t"), F.lit("right")).alias("p"),
        H.object_key(F.col("t")).alias("o"),
        H.hash_prefix(F.lit("abcdef"), 3).alias("x"),
    )
    for row in got.collect():
        assert row.h == by_hand.sha(row.t)
        assert row.r == by_hand.sha("\x00" + row.t + "\x00key")
        assert row.l == by_hand.sha("\x00" + row.t + "|root")
        assert row.p == by_hand.parent(row.t, "right")
        assert row.o == "sha256:" + row.t
        assert row.x == "abc…"


def test_json_strings(spark):
    expected = [by_hand.compact(t) for t in TEXTS]
    assert column(spark, TEXTS, "string", J.js_escapes(J.json_string(F.col("v")))) == expected
    objects = column(spark, TEXTS, "string", J.json_object(F.col("v").alias("b"), F.lit("x").alias("a")))
    assert objects == [by_hand.compact({"b": t, "a": "x"}) for t in TEXTS]
    arrays = column(spark, TEXTS, "string", J.json_string_array(F.array(F.col("v"), F.lit("z"))))
    assert arrays == [by_hand.compact([t, "z"]) for t in TEXTS]


def test_null_object_fields_are_left_out(spark):
    got = column(spark, [None], "string", J.json_object(F.col("v").alias("b"), F.lit("x").alias("a")))
    assert got == ['{"a":"x"}']


def test_canonical_json(spark):
    texts = ['{"b": [2, {"z":1,"a":null}], "a":"x\\u001f"}', '"s"', "[]", "not json", None]
    expected = ['{"a":"x\\u001f","b":[2,{"a":null,"z":1}]}', '"s"', "[]", None, None]
    assert column(spark, texts, "string", J.canonical_json(F.col("v"))) == expected


@pytest.mark.parametrize(
    "value,text",
    [
        (5.0, "5"), (-0.0, "0"), (0.0, "0"), (100.0, "100"), (37.4275, "37.4275"),
        (-122.1697, "-122.1697"), (1e-4, "0.0001"), (1.5e-6, "0.0000015"), (1e-7, "1e-7"),
        (1.25e-9, "1.25e-9"), (1e7, "10000000"), (12345678.5, "12345678.5"),
        (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"),
        (-3e22, "-3e+22"), (9007199254740992.0, "9007199254740992"), (0.1 + 0.2, "0.30000000000000004"),
    ],
)
def test_js_number(spark, value, text):
    assert column(spark, [value], "double", J.js_number(F.col("v"))) == [text]


def test_js_number_matches_shortest_text(spark):
    rng = random.Random(4)
    values = [rng.uniform(-1000, 1000) for _ in range(500)]
    values += [round(rng.uniform(0, 1e9), 3) for _ in range(500)]
    expected = [repr(v).removesuffix(".0") for v in values]
    assert column(spark, values, "double", J.js_number(F.col("v"))) == expected


def test_round_half_up(spark):
    values = [-2.5, -0.5, 0.5, 2.5, 1.4, -1.6]
    expected = [math.floor(v + 0.5) for v in values]
    assert column(spark, values, "double", X.round_half_up(F.col("v"))) == expected
    assert column(spark, [0.25, -0.25], "double", X.round_half_up(F.col("v"), 1)) == [0.3, -0.2]


def test_fixed_two_uses_exact_value(spark):
    rng = random.Random(7)
    values = [0.0, 1.005, 2.675, 0.125, 26.055, 8.345, 1.255, 99.995, 50.0, 1234.5]
    values += [round(rng.uniform(0, 100), 3) for _ in range(2000)]
    expected = [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert column(spark, values, "double", X.fixed_two(F.col("v"))) == expected


def test_text_formatting(spark):
    row = spark.sql(
        "select timestamp_ntz '2024-01-02 03:04:05.678901' a, timestamp_ntz '2024-01-02 03:04:05' b, "
        "'2024-01-02T03:04:05.678Z' c, '2024-01-02T03:04:05+02:00' d, 'x' e"
    ).select(
        X.iso_utc(F.col("a")), X.iso_utc(F.col("b")), X.clock_time(F.col("c")),
        X.clock_time(F.col("d")), X.clock_time(F.col("e")),
        X.cut(F.lit("abc"), 3, "…"), X.cut(F.lit("abcd"), 3, "…"),
        X.plural_label(F.lit(1)), X.plural_label(F.lit(0)),
        X.node_device(F.lit("phone/turn/x")), X.js_trim(F.lit("﻿ \n a b 　")),
        X.head_lines(F.lit("1\n2\n3"), 2), X.head_lines(F.lit("1\n2"), 5),
        X.tail_lines(F.lit("1\n2\n3"), 2), X.tail_lines(F.lit("1"), 2),
        X.turn_preview(F.lit("human"), F.lit("web"), F.lit("y" * 161)),
    ).first()
    assert tuple(row) == (
        "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05.000Z", "03:04:05", "01:04:05", None,
        "abc", "abc…", "1 FCO", "0 FCOs", "phone", "a b", "1\n2", "1\n2",
        "2\n3", "1",
        "human via web: " + "y" * 160 + "...",
    )


def test_gps_parse(spark):
    texts = ["37.5° N, -122.25° W", "-1.5°  N,2.5°W", "no fix", "37° N, 122° W", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    lat, lng = X.gps_parse(F.col("t"))
    rows = [tuple(r)[1:] for r in sorted(df.select("i", lat, lng).collect())]
    default = (37.4275, -122.1697)
    assert rows == [(37.5, -122.25), (-1.5, 2.5), default, default, default]


def chunks_by_hand(text: str, limit: int) -> list[str]:
    import re

    text = text.strip()
    if not text:
        return []
    if len(text) <= limit:
        return [text]
    done, cur = [], ""
    for para in re.split(r"\n\n+", text):
        if cur and len(cur + "\n\n" + para) > limit:
            done.append(cur.strip())
            cur = para
        else:
            cur = cur + "\n\n" + para if cur else para
    if cur.strip():
        done.append(cur.strip())
    return done


def test_text_chunks(spark):
    rng = random.Random(3)
    texts = ["", "  \n ", "short", "a" * 50, "x" * 30 + "\n\n" + "y" * 5, "\n\nlead" + "z" * 20]
    for _ in range(50):
        paragraphs = ["w" * rng.randint(0, 15) for _ in range(rng.randint(1, 20))]
        texts.append(("\n" * rng.randint(2, 4)).join(paragraphs))
    got = column(spark, texts, "string", X.text_chunks(F.col("v"), max_chars=20))
    assert got == [chunks_by_hand(t, 20) for t in texts]


def test_prompt_and_history(spark):
    df = spark.sql(
        "select array(named_struct('role','user','content','a'), named_struct('role','model','content','b')) h"
    )
    row = df.select(
        X.history_text(F.col("h")).alias("t"),
        X.prompt_text(F.lit("sys"), X.history_text(F.col("h")), F.lit("m")).alias("p"),
    ).first()
    assert row.t == "Human: a\nAI: b"
    assert row.p == "sys\n\nChat history:\nHuman: a\nAI: b\n\nHuman: m\nAI:"


def test_risk_rules(spark):
    rules = R.RiskRules(signatures=("QQQ",))
    values = ["", "abRICINcd", "A" * 250, "A" * 251, "QQQA", "AQQQ", "toxin"]
    expected = ["green", "red", "green", "red", "red", "green", "red"]
    assert column(spark, values, "string", R.risk_level(F.col("v"), rules)) == expected
    texts = column(spark, values, "string", R.risk_assessment(F.col("v"), rules))
    assert texts == [rules.red_text if level == "red" else rules.green_text for level in expected]


def test_threat_warning(spark):
    values = ["a Ricin case", "ribosome-inactivating", "HIGH RISK", "none", None]
    warned = [R.THREAT_WARNING] * 3 + [None, None]
    assert column(spark, values, "string", R.threat_warning(F.col("v"))) == warned


def test_utf16_lengths(spark):
    """Against Python's own UTF-16, with halves as U+FFFD."""
    texts = ["", "a", "\U0001f600", "a\U0001f600b", "\U0001f600" * 5, "é\u4e2d" * 4, "abc\U00010348", "\ufffd\U0001f600", "ab\u00a0cd", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    heads = {n: X.utf16_head(F.col("x"), n).alias(f"h{n}") for n in (1, 2, 3, 4, 7)}
    for r in rows.select("i", X.utf16_length(F.col("x")).alias("n"), *heads.values()).collect():
        text = texts[r.i]
        if text is None:
            assert r.n is None and r.h3 is None
            continue
        units = text.encode("utf-16-be")
        assert r.n == len(units) // 2
        for n in heads:
            assert r[f"h{n}"] == units[: 2 * n].decode("utf-16-be", "replace")
    paragraphs = "\U0001f600" * 4 + "\n\n" + "b" * 3 + "\n\n" + "c" * 9
    parts = rows.limit(1).select(X.text_chunks(F.lit(paragraphs), max_chars=12).alias("p")).first().p
    assert parts == ["\U0001f600" * 4, "b" * 3, "c" * 9]
    assert rows.limit(1).select(X.text_chunks(F.lit(paragraphs), max_chars=13).alias("p")).first().p[0] == paragraphs[:9]
