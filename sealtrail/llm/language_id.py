"""Language ID by a byte convolutional network, trained in numpy.

A text is lower-cased, its other ASCII signs become spaces, and its bytes are cut
into windows of ``WINDOW``; the last one is filled up.  Bytes are embedded, filters
of several widths slide over each window, each filter's largest answer goes to
a softmax.  A document's chances are its windows' means, weighted by their bytes,
so the whole text counts.

The convolution needs no copies: for each phase below a filter's width the
embedded bytes are viewed as rows of that width.

The network learns from at most ``LEARN_DOCS`` documents per language and
``LEARN_WINDOWS`` windows of each, so what the driver holds is bounded.

Defined results: null text or text without a letter is ``und`` with score 0.
Without any labelled rows all is ``und``.  A row with a null id is never learned
from and not held out.  Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealtrail.llm.common import free_name, slices

WINDOW = 240
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSION = 8
LEARN_DOCS = 500
LEARN_WINDOWS = 3
STEPS, BATCH = 360, 128
PARTS = 64
FOLDS, HELD_OUT = 4, 2

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row's id falls into the fold; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def plain_bytes(text: str | None) -> bytes:
    """The bytes that the network reads; none if there is no letter."""
    found = _LETTER.search(text) if text else None
    # The pattern also finds numerals that are no digits.
    if not found or not (found[0].isalpha() or any(map(str.isalpha, text))):
        return b""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes, filled up with 0), their document and how many bytes they hold."""
    filled = b"".join(t + bytes(-len(t) % WINDOW) for t in texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    held = np.full(len(owner), WINDOW)
    full = np.flatnonzero(per)
    held[np.cumsum(per)[full] - 1] = sizes[full] - (per[full] - 1) * WINDOW
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), owner, held


class Network:
    def __init__(self, languages: list[str], seed: int = 1):
        random = np.random.default_rng(seed)
        self.languages = languages
        f32 = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        self.parts = {"embed": f32(256, DIMENSION, scale=0.5)}
        self.parts["embed"][0] = 0
        for w in WIDTHS:
            self.parts[f"filter{w}"] = f32(w * DIMENSION, FILTERS, scale=(w * DIMENSION) ** -0.5)
            self.parts[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.parts["out"] = f32(len(WIDTHS) * FILTERS, len(languages), scale=0.1)
        self.parts["out_bias"] = np.zeros(len(languages), np.float32)

    def pooled(self, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest answer in each window, and where it was if asked for."""
        count = len(rows)
        flat = self.parts["embed"][rows.ravel()]
        pools, spots = [], []
        for w in WIDTHS:
            best = spot = None
            for phase in range(w):
                n = (WINDOW * count - phase) // w
                view = flat[phase : phase + n * w].reshape(n, w * DIMENSION)
                answer = view @ self.parts[f"filter{w}"]
                per = WINDOW // w
                if n < count * per:
                    answer = np.concatenate([answer, np.zeros((count * per - n, FILTERS), np.float32)])
                answer = answer.reshape(count, per, FILTERS)
                if phase:
                    answer = answer[:, :-1]  # the last one reaches into the next window
                top = answer.max(1)
                if places:
                    at = answer.argmax(1) * w + phase
                    spot = at if best is None else np.where(top > best, at, spot)
                best = top if best is None else np.maximum(best, top)
            pools.append(best + self.parts[f"bias{w}"])
            spots.append(spot)
        return np.maximum(np.concatenate(pools, 1), 0), np.stack(spots, 1) if places else None

    def chances(self, pooled: np.ndarray) -> np.ndarray:
        score = pooled @ self.parts["out"] + self.parts["out_bias"]
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        count = len(rows)
        pooled, spots = self.pooled(rows, places=True)
        error = self.chances(pooled)
        error[np.arange(count), labels] -= 1
        error /= count
        out = {"out": pooled.T @ error, "out_bias": error.sum(0)}
        back = (error @ self.parts["out"].T) * (pooled > 0)
        embed = np.zeros_like(self.parts["embed"])
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            seen = rows[np.arange(count)[:, None, None], spots[:, i][:, :, None] + np.arange(w)]
            patch = self.parts["embed"][seen].reshape(count, FILTERS, w * DIMENSION)
            out[f"filter{w}"] = np.einsum("nf,nfd->df", part, patch)
            out[f"bias{w}"] = part.sum(0)
            to = part[:, :, None] * self.parts[f"filter{w}"].T[None]
            np.add.at(embed, seen.ravel(), to.reshape(-1, DIMENSION))
        embed[0] = 0
        out["embed"] = embed
        return out

    def learn(self, rows: np.ndarray, labels: np.ndarray, seed: int = 2) -> None:
        """Adam over mini-batches."""
        random = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.parts.items()}
        square = {k: np.zeros_like(v) for k, v in self.parts.items()}
        order = np.empty(0, np.int64)
        for step in range(1, STEPS + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, random.permutation(len(rows))])
            chosen, order = order[:BATCH], order[BATCH:]
            for k, g in self.gradients(rows[chosen], labels[chosen]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                rate = 0.004 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                self.parts[k] -= rate * mean[k] / (np.sqrt(square[k]) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Chances of each language for each text; rows of texts without bytes are zero."""
        rows, owner, held = windows(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(rows), 512):
            part = slice(at, at + 512)
            np.add.at(out, owner[part], self.chances(self.pooled(rows[part])[0]) * held[part, None])
        total = out.sum(1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each text, spread over it evenly."""
    for batch in batches:
        rows, langs = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = plain_bytes(text)
            count = min(LEARN_WINDOWS, -(-len(raw) // WINDOW))
            for k in range(count):
                at = max(len(raw) - WINDOW, 0) * k // max(count - 1, 1)
                rows.append(raw[at : at + WINDOW].ljust(WINDOW, b"\0"))
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(langs, pa.string())], ["row", "lang"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Learn from the rows that are not held out; None if there are none."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id, FOLDS, HELD_OUT))
    # First within parts of a language, as one language may hold most rows, then over what is left.
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("_id"), "_id")) <= LEARN_DOCS
    narrow = usable.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"))
    narrow = narrow.withColumn("_part", F.pmod(F.hash("_id"), F.lit(PARTS))).withColumn("_first", first("_lang", "_part"))
    narrow = narrow.where("_first").withColumn("_first", first("_lang")).where("_first")
    # At most LEARN_DOCS ids per language.
    chosen = F.broadcast(narrow.select(F.col("_id").alias(doc_id)).distinct())
    rows = usable.join(chosen, doc_id, "left_semi").select(text, lang).mapInArrow(_sampled, "row binary, lang string").toPandas()
    rows = rows.sort_values(["lang", "row"], ignore_index=True)
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    network = Network(languages)
    network.learn(
        np.frombuffer(b"".join(rows["row"]), np.uint8).reshape(-1, WINDOW),
        rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(),
    )
    return network


def identify(
    docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text", keep: bool = False
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    With ``keep``, all columns of ``docs`` and the last two, whose names get
    underscores where they are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            place = batch.schema.get_field_index(text)
            texts = [plain_bytes(t) for t in batch.column(place).to_pylist()]
            if network is None:
                best, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                chances = network.documents(texts)
                best = [network.languages[i] if t else "und" for i, t in zip(chances.argmax(1), texts)]
                score = chances.max(1)
            names = [n for n in batch.schema.names if keep or n != text]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, *added]
            )

    if keep:
        rows, left = docs, docs.schema.fields
    else:
        fold = held_out(doc_id, FOLDS, HELD_OUT).alias("held_out")
        rows = docs.select(F.col(doc_id).alias("doc_id"), fold, F.col(text).alias("text"))
        text = "text"
        left = [f for f in rows.schema.fields if f.name != "text"]
    schema = type(docs.schema)(list(left))
    added = [free_name(docs, "lang_pred"), free_name(docs, "score")] if keep else ["lang_pred", "score"]
    return rows.mapInArrow(run, schema.add(added[0], "string").add(added[1], "double"))
