"""Quality by attention over passages: gated multiple-instance learning, trained in numpy.

A document is a bag of passages of ``PASSAGE`` words.  Each passage becomes a
vector (shares of signs, shape and repetition of words, hashed words), then a
code of ``CODE`` numbers.  A gated attention weighs the codes, their weighted mean is
the document's code, and a logistic layer scores it.  Labels exist for documents
only; which passages matter is learned.

Learned from at most ``LEARN_DOCS`` labelled documents of up to ``LEARN_PASSAGES``
passages, so what the driver holds is bounded; scoring reads all passages.

Defined results: null or empty text is a bag of one empty passage.  Without
any labelled rows all scores are 0.5.  A row with a null id is not held out and
never learned from.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.common import slices, utf8
from sealtrail.llm.language_id import held_out
from sealtrail.llm.words import word_hashes

PASSAGE = 80
HASHED = 128
CODE = 24
GATE = 12
LEARN_DOCS = 6000
LEARN_PASSAGES = 32
STEPS, BATCH = 1500, 64
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    """ASCII signs one by one, and classes of letters, digits, spaces, controls and other bytes."""
    out = np.zeros(256, np.int64)
    number = 6
    for b in range(256):
        if b >= 128:
            out[b] = 1
        elif chr(b).islower():
            out[b] = 2
        elif chr(b).isupper():
            out[b] = 3
        elif chr(b).isdigit():
            out[b] = 4
        elif chr(b).isspace():
            out[b] = 5
        elif b > 32:
            out[b] = number
            number += 1
    return out


_CLASSES = _byte_classes()
_KINDS = int(_CLASSES.max()) + 1
FEATURES = _KINDS + 10 + HASHED


def passages(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector per passage, and the text each belongs to; every text has one at least."""
    texts = len(starts) - 1
    begin, end, word, text_of = word_hashes(raw, starts)
    counts = np.bincount(text_of, minlength=texts)
    per = np.maximum(-(-counts // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(texts), per)
    total = int(first[-1])
    place = np.arange(len(word)) - np.concatenate([[0], np.cumsum(counts)])[text_of]
    passage = first[text_of] + place // PASSAGE
    # A passage's bytes reach from its first word to the next one's; the first also has what stands before.
    head = starts[owner].copy()
    opening = np.flatnonzero(place % PASSAGE == 0)
    later = opening[place[opening] > 0]
    head[passage[later]] = begin[later]
    bounds = np.append(head, len(raw))
    size = np.maximum(np.diff(bounds), 1).astype(np.float64)
    of_byte = np.repeat(np.arange(total), np.diff(bounds))
    signs = np.bincount(of_byte * _KINDS + _CLASSES[raw], minlength=total * _KINDS).reshape(total, _KINDS)
    words = np.maximum(np.bincount(passage, minlength=total), 1).astype(np.float64)
    mean = lambda x: np.bincount(passage, weights=x, minlength=total) / words
    length = (end - begin).astype(np.float64)
    order = np.lexsort((word, passage))
    new = np.ones(len(word))
    new[1:] = (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    again2 = np.zeros(len(word))
    again2[2:] = (word[2:] == word[:-2]) & (passage[2:] == passage[:-2])
    average = mean(length)
    shape = np.stack(
        [
            np.log1p(words), average / 8, np.sqrt(np.maximum(mean(length**2) - average**2, 0)) / 4,
            np.bincount(passage[order], weights=new, minlength=total) / words,
            mean(again), mean(again2), mean(length <= 3), mean(length >= 10), mean(length == 1),
            np.log1p(size) / 8,
        ],
        1,
    )
    slot = (word >> np.uint64(40)).astype(np.int64) % HASHED
    hashed = np.bincount(passage * HASHED + slot, minlength=total * HASHED).reshape(total, HASHED)
    out = np.concatenate([np.sqrt(signs / size[:, None]), shape, np.sqrt(hashed / words[:, None])], 1)
    return out.astype(np.float32), owner


class Attention:
    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        f32 = lambda *shape: (random.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)
        self.parts = {
            "code": f32(FEATURES, CODE), "code_bias": np.zeros(CODE, np.float32),
            "what": f32(CODE, GATE), "gate": f32(CODE, GATE), "weigh": f32(GATE, 1)[:, 0],
            "out": f32(CODE, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        p = self.parts
        code = np.tanh(x @ p["code"] + p["code_bias"])
        what = np.tanh(code @ p["what"])
        gate = 1 / (1 + np.exp(-(code @ p["gate"])))
        energy = (what * gate) @ p["weigh"]
        top = np.full(bags, -np.inf, np.float32)
        np.maximum.at(top, owner, energy)
        weight = np.exp(energy - top[owner])
        weight /= np.bincount(owner, weights=weight, minlength=bags)[owner]
        weight = weight.astype(np.float32)
        bag = np.zeros((bags, CODE), np.float32)
        np.add.at(bag, owner, weight[:, None] * code)
        score = 1 / (1 + np.exp(-(bag @ p["out"] + p["out_bias"])))
        return {"code": code, "what": what, "gate": gate, "weight": weight, "bag": bag, "score": score}

    def gradients(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, owner, len(labels))
        error = ((f["score"] - labels) / len(labels)).astype(np.float32)
        to_bag = error[:, None] * p["out"]
        to_code = f["weight"][:, None] * to_bag[owner]
        along = (to_bag[owner] * f["code"]).sum(1)
        centre = np.bincount(owner, weights=f["weight"] * along, minlength=len(labels))
        energy = (f["weight"] * (along - centre[owner])).astype(np.float32)
        both = energy[:, None] * p["weigh"]
        to_what = both * f["gate"] * (1 - f["what"] ** 2)
        to_gate = both * f["what"] * f["gate"] * (1 - f["gate"])
        to_code += to_what @ p["what"].T + to_gate @ p["gate"].T
        inner = to_code * (1 - f["code"] ** 2)
        return {
            "out": f["bag"].T @ error, "out_bias": error.sum(keepdims=True),
            "weigh": (f["what"] * f["gate"]).T @ energy,
            "what": f["code"].T @ to_what, "gate": f["code"].T @ to_gate,
            "code": x.T @ inner, "code_bias": inner.sum(0),
        }

    def learn(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 6) -> None:
        """Adam over mini-batches of whole bags, with weight decay on the passage encoder."""
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 1e-2)
        x = (x - self.mean) * self.scale
        bounds = np.searchsorted(owner, np.arange(len(labels) + 1))
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        order = np.empty(0, np.int64)
        for step in range(1, STEPS + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, random.permutation(len(labels))])
            chosen, order = order[:BATCH], order[BATCH:]
            size = bounds[chosen + 1] - bounds[chosen]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in chosen])
            found = self.gradients(x[rows], np.repeat(np.arange(len(chosen)), size), labels[chosen])
            found["code"] += 1e-3 * self.parts["code"]
            for k, g in found.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = 0.003 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                self.parts[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)

    def scores(self, x: np.ndarray, owner: np.ndarray, bags: int) -> np.ndarray:
        return self.forward((x - self.mean) * self.scale, owner, bags)["score"].astype(np.float64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        x, owner = passages(*utf8(batch.column(0)))
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        bags = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        fits = pa.array(np.diff(bounds) <= LEARN_PASSAGES)
        made = pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1)], ["bag", "label"])
        yield made.filter(fits)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> Attention | None:
    """Learn from labelled rows that are not held out; None if there are none."""
    known = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out("_id", FOLDS, HELD_OUT))
        .orderBy(F.xxhash64("_id"), "_id").limit(LEARN_DOCS)
    )
    # At most LEARN_DOCS rows.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id")
    rows = rows.select("text", "label").mapInArrow(_bags, "bag binary, label int").toPandas()
    rows = rows.sort_values(["label", "bag"], ignore_index=True)
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["bag"]), np.float32).reshape(-1, FEATURES)
    size = rows["bag"].map(len).to_numpy() // (4 * FEATURES)
    model = Attention()
    model.learn(x, np.repeat(np.arange(len(rows)), size), rows["label"].to_numpy().astype(np.float32))
    return model


def score(docs: DataFrame, model: Attention | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            found = np.full(n, 0.5) if model is None else model.scores(*passages(*utf8(batch.column(2))), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    fold = held_out(doc_id, FOLDS, HELD_OUT).alias("held_out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), fold, F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
