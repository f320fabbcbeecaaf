"""Secret scans with built-in functions only: fixed patterns and a randomness test battery.

A pattern's matches come from one pass: ``\\G`` ties each match to the end of the
one before, so a chunk is a gap and a match, and running lengths give places.

Every run of 20 or more key-like characters is a candidate, cut at each "=" that
is not padding at its end.  One that mixes + or / with - or _ fits no alphabet:
it is split at either kind and at both, and each part of 20 or more is a
candidate, so parts may overlap.  Its encoding is the smallest alphabet that holds it.  Against that alphabet three tests look for
structure: chi-squared for uniform use of the symbols, the runs test about
the middle symbol, and serial correlation; Fisher's method joins their
p-values.  A candidate is a discovery if the battery does not reject randomness
and its chi-squared is far below what worded text of that length would give.
The latter p-values face Benjamini-Hochberg control within the document, with
weights in proportion to length (mean 1): short runs can tell little and get little.

Defined results: a null or empty text has no spans.  Repeated rows give
repeated results.  No rows give no rows.  Places are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: the patterns and least lengths of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_RUN = 20
# What is between two "=" of such a run, with the padding if it is the last.
CUT = (
    r"[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
    r"|[A-Za-z0-9+/_-]{16,19}+=++(?![A-Za-z0-9+/_-])"
)
# Where a part without separators ends, and where one begins that has one kind of separator before and the other after it.
EDGES = (
    r"(?<=[A-Za-z0-9])(?=[+/_-])"
    r"|(?<=[+/])(?=[A-Za-z0-9]{20,}+[_-])|(?<=[_-])(?=[A-Za-z0-9]{20,}+[+/])"
)

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Name, symbols, and how far worded text is from uniform: symbols times the sum of squared shares, less 1.
# Worded text is taken to have a sum of 0.065 with letters, 0.17 with hexadecimal letters, 0.15 with digits.
ENCODINGS = (
    ("decimal", _DIGITS, 0.5),
    ("hex", _DIGITS + "abcdef", 1.7),
    ("upper_hex", _DIGITS + "ABCDEF", 1.7),
    ("base32", _UPPER + "234567", 1.1),
    ("base62", _UPPER + _UPPER.lower() + _DIGITS, 3.0),
    ("base64", _UPPER + _UPPER.lower() + _DIGITS + "+/", 3.2),
    ("base64url", _UPPER + _UPPER.lower() + _DIGITS + "-_", 3.2),
)

FALSE_DISCOVERIES = 0.01
# The battery rejects randomness below this joint p-value.
REJECT = 1e-4
MASK = "[REDACTED]"
_BLOCK = 64


def with_running(
    rows: DataFrame, columns: dict[str, str], join: Callable[[Column, Column], Column], zero: Column
) -> DataFrame:
    """Add inclusive running results of array columns; ``columns`` maps new names to those.

    Worked out in blocks, so no long array is copied per item.  Lambdas refer to
    finished columns only: an expression inside one is evaluated for each item.
    """

    def steps(items: Column, first: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(first.alias("at"), F.slice(F.array(first), 1, 0).alias("out")),
            lambda a, x: F.struct(
                join(a["at"], x).alias("at"), F.concat(a["out"], F.array(join(a["at"], x))).alias("out")
            ),
        )["out"]

    def cut(name: str) -> Column:
        last = F.floor((F.size(name) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(F.col(name), b * _BLOCK + 1, _BLOCK))

    def whole(name: str) -> Column:
        blocks = F.col(f"{name}_blocks")
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        before = F.slice(F.concat(F.array(zero), steps(sums, zero)), F.lit(1), F.size(blocks))
        pairs = F.arrays_zip(blocks.alias("b"), before.alias("first"))
        return F.when(F.size(name) > 0, F.flatten(F.transform(pairs, lambda z: steps(z["b"], z["first"])))).otherwise(
            F.slice(F.array(zero), 1, 0)
        )

    rows = rows.withColumns({f"{name}_blocks": cut(name) for name in columns.values()})
    return rows.withColumns({new: whole(name) for new, name in columns.items()})


def matches(text: Column, found: Column, pattern: str) -> Column:
    """Chunks of a text, each a gap and a match, where ``found`` says that there is any."""
    chunks = F.regexp_extract_all(text, F.lit(r"\G(?s:.*?)(?:" + pattern + ")"), F.lit(0))
    return F.when(found, chunks).otherwise(F.array().cast("array<string>"))


def placed(chunks: Column, ends: Column, kind: str, pattern: str) -> Column:
    """Chunks as (start, end, match); ``value`` is what the kind's least length is about."""
    group = 2 if kind == "assign" else 0

    def one(chunk: Column, end: Column) -> Column:
        found = F.regexp_extract(chunk, pattern, 0)
        return F.struct(
            (end - F.length(found)).alias("start"),
            end.alias("end"),
            found.alias("match"),
            (F.regexp_extract(chunk, pattern, group) if group else found).alias("value"),
        )

    return F.zip_with(chunks, ends, one)


def _normal(z: Column) -> Column:
    """Standard normal distribution function, to seven digits (Abramowitz and Stegun 26.2.17)."""
    size = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + size * 0.2316419)
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-size * size / 2) * 0.3989422804014327 * tail
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def _any_encoding(token: Column, of: Callable[[str, str, float], Column]) -> Column:
    """``of`` the first encoding that holds the token; null if none does."""
    out = None
    for name, symbols, far in ENCODINGS:
        held = F.length(F.translate(token, symbols, "")) == 0
        out = F.when(held, of(name, symbols, far)) if out is None else out.when(held, of(name, symbols, far))
    return out


def with_parts(rows: DataFrame, name: str) -> DataFrame:
    """Cut runs (start, end, match) as candidates (start, end, token), those that no alphabet holds in parts.

    A part between two separators of one kind comes from the split at that kind,
    one between two kinds from ``EDGES``; so none comes twice.  The places follow
    from running lengths over all parts of a document.
    """
    mixed, sizes, ends = f"{name}_mixed", f"{name}_mixed_sizes", f"{name}_mixed_ends"
    parts, part_sizes, part_ends = f"{name}_parts", f"{name}_part_sizes", f"{name}_part_ends"
    plus = lambda a, b: a + b
    unfit = lambda x: x["token"].rlike("[+/]") & x["token"].rlike("[_-]")
    rows = rows.withColumn(
        name,
        F.transform(
            F.filter(name, lambda x: x["end"] - x["start"] >= LEAST_RUN),
            lambda x: F.struct(x["start"], x["end"], F.rtrim(x["match"], F.lit("=")).alias("token")),
        ),
    )
    rows = rows.withColumns(
        {
            mixed: F.transform(
                F.filter(name, unfit),
                lambda x: F.struct(x["start"], x["end"], x["token"], F.length(x["token"]).alias("n")),
            ),
            name: F.filter(name, lambda x: ~unfit(x)),
        }
    )
    # A split at a character loses it, so its pieces count one more each.
    rows = rows.withColumn(sizes, F.transform(mixed, lambda x: 3 * x["n"] + 2))
    rows = with_running(rows, {ends: sizes}, plus, F.lit(0))

    def pieces(x: Column, end: Column) -> Column:
        def split(pattern: str, lost: int, before: Column) -> Column:
            return F.transform(
                F.split(x["token"], pattern),
                lambda p: F.struct(
                    x["start"].alias("first"), (x["start"] + x["n"]).alias("stop"), x["end"].alias("end"),
                    (x["start"] - end + 3 * x["n"] + 2 - before).alias("zero"),
                    p.alias("token"), (F.length(p) + lost).alias("size"), F.lit(lost == 0).alias("edged"),
                ),
            )

        return F.concat(
            split("[+/]", 1, F.lit(0)), split("[_-]", 1, x["n"] + 1), split(EDGES, 0, 2 * x["n"] + 2)
        )

    rows = rows.withColumn(parts, F.flatten(F.zip_with(mixed, ends, pieces)))
    rows = rows.withColumn(part_sizes, F.transform(parts, lambda y: y["size"]))
    rows = with_running(rows, {part_ends: part_sizes}, plus, F.lit(0))

    def place(y: Column, end: Column) -> Column:
        start = y["zero"] + end - y["size"]
        stop = start + F.length(y["token"])
        return F.struct(
            start.alias("start"), F.when(stop == y["stop"], y["end"]).otherwise(stop).alias("end"), y["token"],
            (~y["edged"] | ((start > y["first"]) & ~y["token"].rlike("[+/_-]"))).alias("whole"),
        )

    placed_parts = F.filter(
        F.zip_with(parts, part_ends, place), lambda y: y["whole"] & (y["end"] - y["start"] >= LEAST_RUN)
    )
    return rows.withColumn(
        name,
        F.concat(name, F.transform(placed_parts, lambda y: F.struct(y["start"], y["end"], y["token"]))),
    )


def battery(found: Column) -> Column:
    """Candidates (start, end, token) with encoding, length, and the tests' figures."""
    coded = F.filter(
        F.transform(
            found,
            lambda x: F.struct(
                x["start"], x["end"], x["token"], F.length(x["token"]).cast("double").alias("n"),
                _any_encoding(
                    x["token"],
                    lambda name, symbols, far: F.struct(
                        F.lit(name).alias("name"), F.lit(symbols).alias("symbols"),
                        F.lit(float(len(symbols))).alias("k"), F.lit(far).alias("far"),
                    ),
                ).alias("code"),
            ),
        ),
        lambda x: x["code"].isNotNull() & (x["n"] >= 16),
    )

    def counted(x: Column) -> Column:
        token, symbols = x["token"], x["code"]["symbols"]
        squares = F.aggregate(
            F.split(symbols, ""), F.lit(0.0),
            lambda a, c: a + F.pow(x["n"] - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
        )
        values = F.transform(F.split(token, ""), lambda c: F.position(c, symbols) - 1.0)
        return F.struct(
            x["start"], x["end"], x["n"], x["code"], squares.alias("squares"), values.alias("values")
        )

    def summed(x: Column) -> Column:
        v, n, half = x["values"], x["n"], x["code"]["k"] / 2
        total = F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
        squared = F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)
        neighbours = F.zip_with(
            F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1),
            lambda a, b: F.struct(
                (a * b).alias("product"),
                F.when((a < half) != (b < half), 1.0).otherwise(0.0).alias("turn"),
            ),
        )
        pair = F.aggregate(
            neighbours, F.struct(F.lit(0.0).alias("products"), F.lit(1.0).alias("runs")),
            lambda a, y: F.struct(
                (a["products"] + y["product"]).alias("products"), (a["runs"] + y["turn"]).alias("runs")
            ),
        )
        low = F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y < half, 1.0).otherwise(0.0))
        first_last = F.element_at(v, 1) + F.element_at(v, -1)
        return F.struct(
            x["start"], x["end"], n.alias("n"), x["code"], total.alias("total"), squared.alias("squared"),
            pair.alias("pair"), low.alias("low"), first_last.alias("first_last"),
            (x["code"]["k"] / n * x["squares"] - n).alias("chi2"),
        )

    def tested(x: Column) -> Column:
        n, k, low = x["n"], x["code"]["k"], x["low"]
        df = k - 1
        wilson = (F.pow(x["chi2"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        uniform = 1 - _normal(wilson)
        both = 2 * low * (n - low)
        spread = both * (both - n) / (n * n * (n - 1))
        runs = 2 * (1 - _normal(F.abs(x["pair"]["runs"] - 1 - both / n) / F.sqrt(spread)))
        mean = x["total"] / n
        variance = x["squared"] - n * mean * mean
        covariance = x["pair"]["products"] - mean * (2 * x["total"] - x["first_last"]) + (n - 1) * mean * mean
        serial = 2 * (1 - _normal(F.abs(covariance / variance + 1 / n) * F.sqrt(n)))
        worded = (n - 1) * x["code"]["far"]
        unlike = _normal((x["chi2"] - df - worded) / F.sqrt(2 * (df + 2 * worded)))
        sure = lambda p: F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-300))
        return F.struct(
            x["start"], x["end"], n.alias("n"), x["code"]["name"].alias("encoding"),
            sure(uniform).alias("uniform"),
            F.when(spread > 0, sure(runs)).otherwise(F.lit(1e-300)).alias("runs"),
            F.when(variance > 0, sure(serial)).otherwise(F.lit(1e-300)).alias("serial"),
            unlike.alias("worded"),
        )

    def joined(x: Column) -> Column:
        half = -(F.log(x["uniform"]) + F.log(x["runs"]) + F.log(x["serial"]))
        fisher = F.exp(-half) * (1 + half + half * half / 2)
        return F.struct(
            x["start"], x["end"], x["n"], x["encoding"], fisher.alias("random"), x["worded"],
        )

    return F.transform(F.transform(F.transform(F.transform(coded, counted), summed), tested), joined)


def with_discoveries(rows: DataFrame, name: str) -> DataFrame:
    """Weighted Benjamini-Hochberg over each document's candidates; those found, as (start, end).

    What all items share is handed to each of them, so no lambda works it out again.
    """
    tests = F.col(name)
    shared = F.struct(
        (F.aggregate(tests, F.lit(0.0), lambda a, x: a + x["n"]) / F.greatest(F.size(tests), F.lit(1))).alias("mean"), F.size(tests).alias("m")
    )
    weighed = F.transform(
        F.arrays_zip(tests.alias("t"), F.array_repeat(shared, F.size(tests)).alias("all")),
        lambda z: F.struct(
            F.when(z["t"]["random"] >= REJECT, z["t"]["worded"] * z["all"]["mean"] / z["t"]["n"]).otherwise(F.lit(1.0)).alias("p"),
            z["t"]["start"].alias("start"), z["t"]["end"].alias("end"), z["all"]["m"].alias("m"),
        ),
    )
    rows = rows.withColumn(name, F.array_sort(weighed))
    order = F.col(name)
    passed = F.transform(order, lambda x, i: F.when(x["p"] <= (i + 1) * FALSE_DISCOVERIES / x["m"], x["p"]))
    pairs = F.arrays_zip(order.alias("x"), F.array_repeat(F.array_max(passed), F.size(order)).alias("most"))
    found = F.filter(pairs, lambda z: z["x"]["p"] <= z["most"])
    return rows.withColumn(name, F.transform(found, lambda z: z["x"]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``found`` spans (start, place of kind, kind, end), ``keep``."""
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c) for c in keep)
    )
    whole = F.col("_text")
    least = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "random": CANDIDATE}
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", r"[0-9a-f]{24,}"), ("random", CUT)]
    rows = rows.withColumns({f"_{kind}": matches(whole, whole.rlike(least[kind]), p) for kind, p in kinds})
    rows = rows.withColumns({f"_{kind}_sizes": F.transform(f"_{kind}", lambda c: F.length(c)) for kind, _ in kinds})
    rows = with_running(
        rows, {f"_{kind}_ends": f"_{kind}_sizes" for kind, _ in kinds}, lambda a, b: a + b, F.lit(0)
    )
    rows = rows.withColumns(
        {f"_{kind}": placed(F.col(f"_{kind}"), F.col(f"_{kind}_ends"), kind, p) for kind, p in kinds}
    )
    rows = with_parts(rows, "_random")
    rows = rows.withColumn("_random", battery(F.col("_random")))
    rows = with_discoveries(rows, "_random")

    def spans(kind: str, number: int, found: Column) -> Column:
        return F.transform(
            found,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(number).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")
            ),
        )

    def valid(kind: str) -> Column:
        return F.filter(f"_{kind}", lambda x: F.length(x["value"]) >= LEAST[kind])

    base = [spans(kind, i, valid(kind)) for i, (kind, _) in enumerate(BASE)]
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.array_sort(F.concat(*base)).alias("base"),
        spans("random", 3, F.col("_random")).alias("found"),
        *(F.col(c) for c in keep),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda i: F.size(F.filter("base", lambda x: x["order"] == i)).cast("long")
    return scan(docs, doc_id, text).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with every span's text replaced by a mask; a null text stays null."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("_row"), F.col(text).alias("_source"))
    rows = scan(held, "_row", "_source", ("_source",)).select(
        F.col("doc_id").alias("_row"), "_source", F.array_sort(F.concat("base", "found")).alias("_spans")
    )
    rows = rows.withColumn("_last", F.transform("_spans", lambda x: x["end"]))
    rows = with_running(rows, {"_ends": "_last"}, lambda a, b: F.greatest(a, b), F.lit(0))
    source = F.col("_source")
    before = F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), F.greatest(F.size("_ends") - 1, F.lit(0))))
    parts = F.zip_with(
        F.col("_spans"), F.slice(before, F.lit(1), F.size("_spans")),
        lambda x, at: F.when(
            x["start"] >= at, F.concat(F.substring(source, at + 1, x["start"] - at), F.lit(MASK))
        ).otherwise(F.lit("")),
    )
    clean = F.when(
        F.size("_spans") > 0,
        F.concat(F.array_join(parts, ""), F.substring(source, F.element_at("_ends", -1) + 1, F.length(source))),
    ).otherwise(source)
    rows = rows.withColumn("_clean", clean)
    changed = {text: F.col("_clean")}
    if n_chars in names:
        changed[n_chars] = F.when(F.size("_spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row")[n_chars])
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in names))
