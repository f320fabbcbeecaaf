"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtrail.llm import (
    alignment,
    bpe,
    centroids,
    exact_dedup,
    language_id,
    licences,
    near_dedup,
    nearest,
    packing,
    quality,
    secrets,
    token_counts,
    url_filter,
)
from sealtrail.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.licences(docs, licences.train(docs))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment_digests(docs, vocabulary(), vocabulary("piece_bpe_32k.model"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_licences": op5_licences,
    "op6_nearest": op6_nearest,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_token_counts": op11_token_counts,
    "op12_centroids": op12_centroids,
    "op13_alignment": op13_alignment,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _centroid_sql(rounds: int) -> str:
    """The rounds of op12 one after another, in whole numbers."""
    sql = ["""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        long AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(v) AS x FROM kept),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v
            FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 8))"""]
    for i in range(rounds + 1):
        sql.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, min_by(c, (dist, c)) AS c, min(dist) AS dist
            FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
                  FROM kept CROSS JOIN c{i})
            GROUP BY r)""")
        if i < rounds:
            sql.append(f"""
        c{i + 1} AS MATERIALIZED (
            SELECT c, coalesce(m.v, c{i}.v) AS v
            FROM c{i} LEFT JOIN (
                SELECT c, list(m ORDER BY d) AS v
                FROM (SELECT c, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                      FROM long JOIN a{i} USING (r) GROUP BY c, d)
                GROUP BY c) AS m USING (c))""")
    return ",".join(sql) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
               CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(dist) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""


def _near_sql() -> str:
    """op4 over sets of shingles: pairs that share a shingle among the rarest fifth, full sets, then all that is reachable.

    Two sets that are 80 % alike share one of the rarest n - ceil(0.8 n) + 1 shingles of each.
    """
    return f"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        sets AS MATERIALIZED (
            SELECT r, doc_id, list_sort(list_distinct(CASE
                       WHEN len(w) < 2 THEN w
                       ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
            FROM words),
        nodes AS MATERIALIZED (
            SELECT row_number() OVER () AS k, s, len(s) AS n, min(doc_id) AS least
            FROM sets WHERE len(s) > 0 GROUP BY s),
        each_one AS (SELECT k, n, unnest(s) AS g FROM nodes),
        ranked AS (
            SELECT k, n, g, row_number() OVER (PARTITION BY k ORDER BY f, g) AS place
            FROM (SELECT k, n, g, count(*) OVER (PARTITION BY g) AS f FROM each_one)),
        rare AS MATERIALIZED (SELECT k, n, g FROM ranked WHERE place <= n - ceil(0.8 * n) + 1),
        pairs AS MATERIALIZED (
            SELECT DISTINCT a.k AS a, b.k AS b FROM rare AS a JOIN rare AS b USING (g)
            WHERE a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        common AS (
            SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS c
            FROM pairs JOIN nodes AS x ON x.k = a JOIN nodes AS y ON y.k = b),
        linked AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (total - c)),
        edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
        reached(k, other) AS (
            SELECT k, k FROM nodes
            UNION
            SELECT reached.k, edges.b FROM reached JOIN edges ON reached.other = edges.a),
        parts AS MATERIALIZED (
            SELECT reached.k, min(o.least) AS component_id
            FROM reached JOIN nodes AS o ON o.k = reached.other GROUP BY reached.k)
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
               coalesce(doc_id = coalesce(component_id, doc_id), true) AS kept
        FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN parts USING (k)"""


LLM_ORACLES: dict[str, str] = {
    "op4_near_dedup": _near_sql(),
    "op12_centroids": _centroid_sql(10),
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d""",
}
