"""Nearest neighbours against brute force; URL filters against the rules read plainly."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealtrail.llm import nearest, url_filter

SCHEMA = "vec_id long, embedding array<float>, cell int, score double"


def brute(rows, top):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scores = [(-float((np.array(q) * np.array(v)).sum()), j) for j, v in usable if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:top]]
    return out


@pytest.mark.parametrize("cell,norms", [(4096, False), (60, True)])
def test_nearest(spark, monkeypatch, cell, norms):
    monkeypatch.setattr(nearest, "CELL", cell)
    random = np.random.default_rng(3)
    x = random.standard_normal((700, 16)) * (random.uniform(0.2, 3, (700, 1)) if norms else 1)
    x = x.astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [(700, None), (720, [0.0] * 16), (740, [None] + [1.0] * 15), (760, [float("nan")] * 16), (None, [1.0] * 16)]
    odd += [(780, [float("inf")] + [1.0] * 15), rows[20]]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], SCHEMA).repartition(3)
    found = {}
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(rows + odd, 20)
    assert set(found) == set(expected)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)
    if not norms:
        assert {q: [j for j, _ in v] for q, v in found.items()} == {q: [j for j, _ in v] for q, v in expected.items()}
    exact = {q: dict(v) for q, v in expected.items()}
    for q, hits in found.items():
        assert [s for _, s in hits] == sorted((s for _, s in hits), reverse=True) and len(hits) == 20
        assert all(abs(exact[q][j] - s) < 1e-12 for j, s in hits if j in exact[q])


def test_few_or_no_vectors(spark):
    ask = F.col("vec_id") % 20 == 0
    none = spark.createDataFrame([], SCHEMA)
    assert nearest.nearest(none, ask).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, 1.0), (1, [0.5, 0.5], 1, 1.0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest(two, ask).collect()] == [(0, 1, 1, 0.5)]


def test_repeated_ids_with_other_vectors(spark):
    """An id with two vectors asks with both and is found by both; its own id is never a hit."""
    x = np.random.default_rng(4).standard_normal((12, 4)).astype(np.float32)
    rows = [(i % 6 * 10, [float(a) for a in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], SCHEMA)
    found = {}
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0, top=5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in (0, 20, 40):
        scores = {(j, float(np.dot(np.float64(a), np.float64(b)))) for i, a in rows if i == q for j, b in rows if j != q}
        assert found[q] == [(j, round(s, 9)) for j, s in sorted(scores, key=lambda p: (-p[1], p[0]))[:5]]


@pytest.mark.parametrize("spread,most", [(None, 0.75), (0.4, 0.4)])
def test_stopping_test_leaves_points_out(spread, most):
    """Most of the nearest are found, and a good share of the vectors is never verified."""
    random = np.random.default_rng(8)
    x = random.standard_normal((8000, 48))
    if spread:
        x = x[random.integers(0, 80, 8000)] + spread * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = random.standard_normal((49, nearest.PROJECTED))
    points = np.concatenate([x, np.zeros((8000, 1))], 1) @ axes
    ask = np.arange(0, 8000, 40)
    rows, vecs, scores, verified = nearest.search(
        np.arange(8000), x, points, ask, x[ask], points[ask], np.full(200, -np.inf), 1 + 1e-12, 20, nearest.stop_ratio()
    )
    true = x[ask] @ x.T
    true[np.arange(200), ask] = -np.inf
    best = np.argsort(-true, axis=1)[:, :20]
    hits = sum(len(set(vecs[rows == i]) & set(best[i])) for i in range(200))
    assert hits >= 0.93 * 20 * 200
    assert verified <= most * 200 * 8000
    assert np.allclose(scores, true[rows, vecs])


def test_chi_square():
    ratio = nearest.stop_ratio(0.98, 8)
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((draws <= ratio).mean() - 0.98) < 0.003


def plain(url):
    if "://" not in (url or ""):
        return "", "", None, None
    match = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), match[1]), match[2]
    fits = [
        (at + below, says) for says, at, below in url_filter.RULES
        if (host == at or host.endswith("." + at)) and path.startswith(below)
    ]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://a.org/x?y#z", "https://Example.ORG/es/1", "http://example.org/en/12",
    "http://example.org/en/2", "http://x.com/fr/1", "http://com/fr/", "http://acom/fr/1", "http://x.com/de/?q=://b.org/", "ftp://a.net/de/#://",
    "http://a.net?x=/fr/", "http://a.net#/fr/", "http://ÉA.net/x", "http://example.org/es", "a\nb://x.org/c", "http://x.net/" + "a/" * 3000,
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judge(rows).collect():
        host, path, rule, says = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (says is None or r.verdict == says)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none).count() == 0


def tokens_of(spark, urls):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.parts(F.col("url"))
    return {r.page_id: set(r.t) for r in rows.select("page_id", url_filter.tokens(F.col("url"), host, path).alias("t")).collect()}


def brute_rules(labelled, tokens):
    """All combinations of tokens with confidence and support, as (combination, verdict): (confidence, support)."""
    pages = {}
    for i in labelled:
        for n in range(1, len(tokens[i]) + 1):
            for combination in itertools.combinations(sorted(tokens[i]), n):
                pages.setdefault(combination, []).append(labelled[i])
    least = max(url_filter.LEAST, url_filter.SUPPORT * len(labelled))
    rules = {}
    for combination, says in pages.items():
        for verdict in set(says):
            n = says.count(verdict)
            if n >= least and n / len(says) >= url_filter.CONFIDENCE:
                rules[combination, verdict] = (n / len(says), n / len(labelled))
    return rules


def judged(spark, urls):
    rows = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, _tokens string, verdict int")
    return {r.page_id: r for r in url_filter.judge(rows.repartition(4)).collect()}


def check_against_brute_rules(spark, urls):
    found, tokens = judged(spark, urls), tokens_of(spark, urls)
    labelled = {i: plain(u)[3] for i, u in enumerate(urls) if plain(u)[3]}
    rules = brute_rules(labelled, tokens)
    for i in range(len(urls)):
        fits = [(*figures, verdict) for (combination, verdict), figures in rules.items() if set(combination) <= tokens[i]]
        best = max(fits, default=(0, 0, "allow"))[2]
        assert found[i].verdict == labelled.get(i, best)
    return found, rules


def test_mined_rules_match_brute_force(spark):
    random = np.random.default_rng(1)
    urls = []
    for i in range(1500):
        spam = random.random() < 0.4
        top = random.choice(["com", "org", "net"])
        urls.append(f"http://{'pills' if spam else 'news'}.{top}/{'de' if spam else 'fr'}/{i}?{'buy' if spam else 'read'}=1")
    _, rules = check_against_brute_rules(spark, urls)
    assert rules


def test_rules_of_four_tokens_and_of_words_with_digits(spark):
    """``a``, ``b``, ``c`` and ``d`` mean block only together; ``v2`` means block alone; what stands on four pages means nothing."""
    urls, words = [], "abcd"
    for k in range(4):
        three = [w for j, w in enumerate(words) if j != k]
        urls += [f"http://x.com/fr/{'/'.join(three)}"] * 60
    urls += ["http://x.com/de/a/b/c/d"] * 9 + ["http://x.com/de/v2/zz"] * 8 + ["http://x.com/de/rare"] * 4
    first = len(urls)
    urls += ["http://y.net/q/d/c/b/a", "http://y.net/a/b/c", "http://y.net/v2", "http://y.net/zz", "http://y.net/rare", None]
    # The label's own path words would settle all; the open pages have none of them.
    found, rules = check_against_brute_rules(spark, urls)
    assert (("path a", "path b", "path c", "path d"), "block") in rules
    assert [found[first + i].verdict for i in range(6)] == ["block", "allow", "block", "block", "allow", "allow"]


def test_many_tokens_on_the_same_pages_are_one_class(spark):
    """Forty words that stand on the same 300 pages would have 2^40 combinations."""
    long = "/".join(f"w{i}" for i in range(40))
    urls = [f"http://x.com/de/{long}"] * 300 + ["http://x.com/fr/news"] * 300 + ["http://y.net/w7", "http://y.net/news/w99"]
    found = judged(spark, urls)
    assert found[600].verdict == "block" and found[601].verdict == "allow"
