"""Near duplicates: SetSketch registers, bands, joint likelihood, then exact verification.

Each register is the exponent, to a base just over 1, of the least of
exponentially distributed hashes of a document's shingles.  Registers of a union
are the larger of two registers, so sketches merge; two registers are equal
with about the probability of the Jaccard similarity.  ``ROWS`` registers form a
band; with ``BANDS`` bands a pair at the limit shares none with probability 3e-6.

Documents with equal sets are one node.  No bucket of a band is expanded into
its pairs.  First each node meets the centres of its buckets, one per band at
most; a bucket's centre is its member with the best filled buckets, as a text is
that others were copied from.  Links found make components; only where a bucket
still holds several components do the members of all but its largest one meet
the rest.  So every pair of a bucket is either inside one component or checked.
In buckets of up to ``SMALL`` members such pairs are listed; a pair goes on to
verification unless its registers are e**-12.5 times less likely at the limit
or above than at their best, and verification compares the full sets.  Larger
buckets are compared block by block on the full sets, of which only links come
out, one for each member and component.

Defined results: null, empty or white-space texts have an empty set and are
linked with nothing.  A row with a null id counts as a text of its own and has
that text's component.  Repeated rows are equal sets.  No rows give no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.common import free_name, slices, stored, utf8
from sealtrail.llm.words import FACTOR, mixed, word_hashes

WORDS = 2
SIMILARITY = 80  # per cent
BANDS, ROWS = 24, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
LEAST_LOG_RATIO = -12.5
SMALL = 24
BLOCK = 256
# Text that is cut into shingles at a time; arrays of it take about 40 times as much.
SLICE = 1 << 18

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_SPREAD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MARKS = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin.

    A text with fewer words than a shingle is one shingle.
    """
    texts = len(starts) - 1
    begin, _, word, text_of = word_hashes(raw, starts)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(texts + 1, np.int64)
    per_text = np.bincount(text_of, minlength=texts)
    word_start = np.concatenate([[0], np.cumsum(per_text)])
    made = np.where(per_text >= words, per_text - words + 1, np.minimum(per_text, 1))
    shingle_start = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(texts), made)
    at = np.arange(shingle_start[-1]) - shingle_start[owner] + word_start[owner]
    size = np.minimum(per_text[owner], words)
    shingle = size.astype(np.uint64)
    for k in range(words):
        there = k < size
        shingle = np.where(there, mixed(shingle * np.uint64(FACTOR) + word[np.minimum(at + k, len(word) - 1)]), shingle)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=texts)
    return shingle[new], np.concatenate([[0], np.cumsum(counts)])


def registers(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of registers per set; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(starts))
    least = np.empty((len(full), BANDS * ROWS), np.uint64)
    begin = starts[full]
    for i, factor in enumerate(_SPREAD):
        spread = shingles * factor
        spread ^= spread >> np.uint64(32)
        spread *= factor
        least[:, i] = np.minimum.reduceat(spread, begin) if len(full) else 0
    share = (least.astype(np.float64) + 0.5) / 2.0**64
    exponent = np.floor(1 - np.log(-np.log1p(-share) / RATE) / np.log(BASE))
    out = np.zeros((len(starts) - 1, BANDS * ROWS), np.uint16)
    out[full] = np.clip(exponent, 0, TOP + 1)
    return out


def _digest(items: np.ndarray) -> bytes:
    return hashlib.sha256(items.tobytes()).digest()[:16]


def sketched(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Sketches of rows (doc_id, text), see ``sketches``."""
    for batch in slices(batches, "text", SLICE):
        items, starts = shingle_sets(*utf8(batch.column(1)), words)
        made = registers(items, starts)
        keys = (made.reshape(-1, BANDS, ROWS).view(np.uint64)[:, :, 0] ^ _BAND_MARKS) * np.uint64(FACTOR)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(made) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64))
        )
        nodes = [_digest(items[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(starts)), pa.array(nodes, pa.binary()), lists,
                pa.array([r.tobytes() for r in made], pa.binary()),
            ],
            ["doc_id", "n_shingles", "node", "bands", "registers"],
        )


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), bands, registers."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: sketched(batches, words),
        f"doc_id {kind}, n_shingles long, node binary, bands array<long>, registers binary",
    )


def log_ratios(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Best log-likelihood at the limit or above, less the best at any similarity.

    Given the sizes, the numbers of registers that are larger, smaller and equal
    have a joint likelihood that depends on the similarity alone.
    """
    larger, smaller = (one > two).sum(1), (one < two).sum(1)
    equal = one.shape[1] - larger - smaller
    u = n_one / (n_one + n_two)
    most = np.minimum(n_one, n_two) / np.maximum(n_one, n_two)
    limit = SIMILARITY / 100
    best_any = np.full(len(one), -np.inf)
    best_high = np.full(len(one), -np.inf)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    for j in np.linspace(0, 1, 101):
        plus, minus = chance(u - (1 - u) * j), chance((1 - u) - u * j)
        same = np.maximum(1 - plus - minus, 1e-12)
        value = larger * np.log(np.maximum(plus, 1e-12)) + smaller * np.log(np.maximum(minus, 1e-12))
        value = np.where(j <= most + 1e-9, value + equal * np.log(same), -np.inf)
        best_any = np.maximum(best_any, value)
        if j >= limit - 1e-9:
            best_high = np.maximum(best_high, value)
    return best_high - best_any


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the likelihood does not rule out; sizes alone rule out some."""
    for batch in batches:
        n_one, n_two = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if not len(n_one):
            continue
        sketch = [
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(n_one), -1) for i in (4, 5)
        ]
        fits = 100 * np.minimum(n_one, n_two) >= SIMILARITY * np.maximum(n_one, n_two)
        fits &= log_ratios(*sketch, n_one, n_two) >= LEAST_LOG_RATIO
        yield batch.filter(pa.array(fits)).select(["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        fits = []
        for i in range(batch.num_rows):
            x = np.frombuffer(one[i].as_buffer(), np.uint64)
            y = np.frombuffer(two[i].as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            fits.append(100 * common >= SIMILARITY * (len(x) + len(y) - common))
        yield batch.filter(pa.array(fits, pa.bool_())).select(["a", "b"])


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)


def block_links(fewer: pa.Table, others: pa.Table) -> pa.Table:
    """Links between two blocks of sets with different labels; one for each of ``fewer`` and label."""
    a, b = fewer["node"].to_pylist(), others["node"].to_pylist()
    out: dict[tuple[bytes, bytes], bytes] = {}
    if a and b:
        items, sizes = _sets(fewer["items"])
        order = np.argsort(items, kind="stable")
        items, owner = items[order], np.repeat(np.arange(len(a)), sizes)[order]
        label_a, label_b = fewer["label"].to_pylist(), others["label"].to_pylist()
        for j, value in enumerate(others["items"]):
            one = np.frombuffer(value.as_buffer(), np.uint64)
            low, high = np.searchsorted(items, one, "left"), np.searchsorted(items, one, "right")
            found = high - low
            at = np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())
            common = np.bincount(owner[at], minlength=len(a))
            linked = (100 * common >= SIMILARITY * (sizes + len(one) - common)) & (common > 0)
            for i in np.flatnonzero(linked):
                if label_a[i] != label_b[j]:
                    out.setdefault((a[i], label_b[j]), b[j])
    return pa.table(
        [pa.array([x for x, _ in out], pa.binary()), pa.array(list(out.values()), pa.binary())], names=["a", "b"]
    )


def set_table(docs: DataFrame, text: str, words: int) -> DataFrame:
    """node and its sorted shingle hashes, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            items, starts = shingle_sets(*utf8(batch.column(0)), words)
            sets = [items[a:b] for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "items"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "node binary, items binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, by large and small stars.

    Each step is a join on nodes; steps are about the logarithm of the longest
    path.  Nothing but a count reaches the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = stored(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = small.union(joined.select("a", F.col("m").alias("b"))).distinct()


class _Search:
    """Rounds of pairs over one set of buckets."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int):
        self.rows = stored(sketches(docs, doc_id, text, words))
        # Two different sets below four shingles are never similar enough.
        self.nodes = stored(
            self.rows.where(F.col("n_shingles") * (100 - SIMILARITY) >= SIMILARITY)
            .groupBy("node")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "n_shingles", "bands", "registers")).alias("r"))
            .select("node", "r.*").drop("x")
        )
        members = self.nodes.select(F.explode("bands").alias("key"), "node")
        sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = stored(members.join(sizes, "key"))
        filled = shared.groupBy("node").agg(F.sum("n").alias("filled"))
        centres = shared.join(filled, "node").groupBy("key").agg(F.max(F.struct("filled", "node")).alias("c"))
        self.buckets = stored(shared.join(centres.select("key", F.col("c.node").alias("centre")), "key"))
        involved = self.nodes.join(self.buckets, "node", "left_semi").select(F.col("doc_id").alias("_id"))
        read = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t"))
        read = read.join(involved, read["_d"].eqNullSafe(involved["_id"]), "left_semi")
        # Rows that share an id, or have none, are read for each other's nodes: one set of a node is enough.
        self.sets = stored(set_table(read, "_t", words).dropDuplicates(["node"]))
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        labels = self.labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
        return rows.join(labels, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")

    def add(self, links: DataFrame) -> None:
        """Join verified links to the components."""
        self.links = links if self.links is None else self.links.union(links)
        self.labels = stored(components(self.links))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) that are links: estimated first, then compared."""
        facts = self.nodes.select("node", "n_shingles", "registers")
        side = lambda x: facts.toDF(x, f"n_{x}", f"r_{x}")
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        likely = sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_likely, "a binary, b binary")
        with_a = likely.join(self.sets.toDF("a", "items_a"), "a")
        full = with_a.join(self.sets.toDF("b", "items_b"), "b").select("a", "b", "items_a", "items_b")
        return stored(full.mapInArrow(_linked, "a binary, b binary"))

    def run(self) -> DataFrame:
        stars = self.buckets.where("node != centre")
        stars = stored(_pairs(stars.select(F.col("node").alias("a"), F.col("centre").alias("b"))))
        self.add(self.verified(stars))
        open_ = stored(self.open_members())
        fewer, small = open_.where("label != top"), F.col("n") <= SMALL
        listed = (
            fewer.where(small).select("key", F.col("node").alias("a"), F.col("label").alias("la"))
            .join(open_.where(small).select("key", F.col("node").alias("b"), F.col("label").alias("lb")), "key")
            .where("la != lb")
        )
        links = self.verified(_pairs(listed).join(stars, ["a", "b"], "left_anti"))
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
        place = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
        one = fewer.where(~small).select("key", "node", "label", place(F.col("few")).alias("x"), each(F.col("n")).alias("y"))
        all_ = open_.where(~small).select("key", "node", "label", each(F.col("few")).alias("x"), place(F.col("n")).alias("y"))
        keys = ["key", "x", "y"]
        # New column identities, as both sides come from the same tables.
        with_items = lambda rows: rows.join(self.sets, "node").select(*keys, "node", "label", "items").toDF(
            *keys, "node", "label", "items"
        )
        compared = with_items(one).groupBy(*keys).cogroup(with_items(all_).groupBy(*keys)).applyInArrow(
            block_links, "a binary, b binary"
        )
        self.add(links.union(stored(compared)))
        return self.labels

    def open_members(self) -> DataFrame:
        """Members of buckets that hold several components: their labels, the largest one, and how many lie outside it."""
        members = self.labelled(self.buckets.select("key", "node", "n"), "node", "label")
        sizes = members.groupBy("key", "label").agg(F.count("*").alias("m"))
        largest = (
            sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "label")).alias("t"), F.sum("m").alias("all"))
            .where("parts > 1").select("key", F.col("t.label").alias("top"), (F.col("all") - F.col("t.m")).alias("few"))
        )
        return members.join(largest, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    search = _Search(docs, doc_id, text, words)
    labels = search.run()
    rows = search.rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    rows = rows.withColumn("_label", F.coalesce("label", "node"))
    least = rows.where("n_shingles > 0").groupBy("_label").agg(F.min("doc_id").alias("_least"))
    component = F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id"))
    return rows.join(least, "_label", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, the one of the smallest id.

    A row is known by its id and its whole text, so of rows that share an id only the near
    copies go.  Null ids come last.  Of rows alike in id and text one stays; those
    without words are linked with nothing and stay.  What is joined is few: the rows
    that go, and those that are repeated.
    """
    key = free_name(docs, "_key")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    keyed = docs.withColumn(key, F.struct(F.col(doc_id).isNull().alias("x"), F.col(doc_id).alias("y"), digest.alias("z")))
    found = stored(near_copies(keyed, key, text, words))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    again = found.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("doc_id").alias("_again"))
    left = keyed.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    single = left.join(again, F.col(key) == F.col("_again"), "left_anti")
    repeated = left.join(again, F.col(key) == F.col("_again"), "left_semi").dropDuplicates([key])
    return single.unionByName(repeated).select(*docs.columns)
