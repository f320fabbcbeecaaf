"""URL filters: fixed host and path rules, then association rules mined from their labels.

Pages that a fixed rule judges are the labelled ones.  A URL's tokens are its
host's labels and its path's and query's words; together with the label they are
a transaction.  Tokens that stand on just the same labelled pages are one class:
they cannot be told apart, and a page with many of them would have a power of two of
combinations.  Spark's FP-growth mines combinations of classes that imply a label;
those with ``CONFIDENCE`` and on ``SUPPORT`` of the pages, ``LEAST`` pages at any rate,
are kept, however long, if no part of the combination implies the same at least as
surely.  The rest of the pages are matched by an inverted index from token by class to
rule: pages with the same tokens are matched once, and a rule holds if a token of each
of its classes is met, as then some combination of tokens with these figures is.
Without a mined rule the verdict is allow.

Defined results: a null URL or one without ``://`` has an empty host and path and no tokens
but those of its query, and no fixed rule.  Of fixed rules the longest wins; of mined ones the surest, then
the more frequent, then block.  Repeated rows get equal verdicts, and each counts as a page.
Other columns are not read, whatever their names.  An empty table gives no rows; without labelled
pages all are allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.common import stored

# Fixed: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT = 0.005
LEAST = 5
CONFIDENCE = 0.8
_LABEL = "= "
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    text = F.coalesce(url, F.lit(""))
    rest = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, rest, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, rest, 2)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        rule, verdict = F.when(fits, at + below).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; those of few pages drop out by their support."""
    split = lambda text, cut, mark: F.transform(F.split(text, cut), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    found = F.concat(split(host, r"\.", "host "), split(path, r"[/.]", "path "), split(query, r"[&=]", "query "))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"(?s)^\w+ .")))


def token_classes(labelled: DataFrame) -> DataFrame:
    """Rows (_token, class): tokens on just the same of the pages (page, items) have their least token as class.

    Two sums of hashes of the page numbers stand for the set of pages, 128 bits in all.
    """
    pages = labelled.select("page", F.explode("items").alias("_token"))
    mark = lambda seed: F.sum(F.xxhash64("page", F.lit(seed)).cast("decimal(38,0)"))
    marked = pages.groupBy("_token").agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    marked = marked.where(F.col("n") >= LEAST)
    return marked.join(marked.groupBy("n", "x", "y").agg(F.min("_token").alias("class")), ["n", "x", "y"]).select("_token", "class")


def mined_rules(labelled: DataFrame) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows (items, verdict)."""
    count = labelled.count()
    label = F.array(F.concat(F.lit(_LABEL), "verdict"))
    support = min(1.0, max(SUPPORT, LEAST / max(count, 1)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE).fit(
        labelled.select(F.concat("items", label).alias("items"))
    )
    rules = stored(
        model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL))
        .where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .where(F.col("support") * count >= LEAST - 0.5)
        .select(
            F.array_sort("antecedent").alias("antecedent"),
            F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 10).alias("verdict"),
            "confidence", "support",
        )
    )
    # A part that is at least as sure fits wherever the whole does and wins there, so what
    # goes here changes no verdict; parts that lack one class, and single classes, are looked at.
    one = lambda x: F.array(x)
    but_one = lambda x: F.array_except("antecedent", F.array(x))
    less = F.filter(F.concat(F.transform("antecedent", one), F.transform("antecedent", but_one)), lambda x: F.size(x) > 0)
    general = rules.select(F.col("antecedent").alias("_part"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_sure"))
    covered = (
        rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode(less).alias("_part"))
        .join(general, "_part").where((F.col("verdict") == F.col("_verdict")) & (F.col("_sure") >= F.col("confidence")))
        .select("antecedent", "verdict")
    )
    return rules.join(covered, ["antecedent", "verdict"], "left_anti")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    host, path = parts(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "_fixed": verdict, "_tokens": tokens(F.col("_url"), F.col("host"), F.col("path"))})
    rows = stored(rows.select("page_id", "host", "path", "rule", "_fixed", "_tokens"))
    # The written table fixes the page numbers.
    labelled = stored(
        rows.where("_fixed is not null")
        .select(F.monotonically_increasing_id().alias("page"), F.col("_tokens").alias("items"), F.col("_fixed").alias("verdict"))
    )
    classes = stored(token_classes(labelled))
    in_classes = (
        labelled.select("page", "verdict", F.explode("items").alias("_token")).join(classes, "_token")
        .groupBy("page", "verdict").agg(F.collect_set("class").alias("items"))
    )
    items = labelled.select("page", "verdict").join(in_classes.select("page", "items"), "page", "left")
    items = stored(items.select("verdict", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    rules = stored(mined_rules(items).withColumn("_rule", F.monotonically_increasing_id()))
    # Only tokens of rules matter; pages that meet the same classes are matched once.
    index = rules.select("_rule", F.size("antecedent").alias("_size"), F.explode("antecedent").alias("_class"))
    used = classes.withColumnRenamed("class", "_class").join(index.select("_class").distinct(), "_class", "left_semi")
    open_ = rows.where("_fixed is null").select("_tokens").distinct()
    named = open_.select("_tokens", F.explode("_tokens").alias("_token")).join(used, "_token")
    kinds = stored(named.groupBy("_tokens").agg(F.array_sort(F.collect_set("_class")).alias("_kind")))
    met = (
        kinds.select("_kind").distinct().select("_kind", F.explode("_kind").alias("_class")).join(index, "_class")
        .groupBy("_kind", "_rule", "_size").agg(F.count("*").alias("_met")).where("_met = _size")
    )
    best = (
        met.join(rules, "_rule").groupBy("_kind")
        .agg(F.max(F.struct("confidence", "support", "verdict")).alias("_best"))
        .select("_kind", F.col("_best.verdict").alias("_mined"))
    )
    verdicts = kinds.join(best, "_kind").select("_tokens", "_mined")
    return rows.join(verdicts, "_tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit("allow")).alias("verdict")
    )
