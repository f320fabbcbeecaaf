"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a run of lines up to one without words; words are letters and
digits, so comment marks do not count and a notice may be wrapped anywhere.
Every paragraph is judged as overlapping windows of 8, 16, 32 and 64 words, each size
beginning at every half of it, or as a whole if it is shorter.  A window's one-, two- and three-word runs and
the words that begin and end its lines, hashed, are the sparse features of a multinomial logistic
regression over licence families and ``unknown``.  A family is predicted where it is likelier than
``unknown`` and all others and has at least the calibrated chance.  It learns from the notices
below, with words left out, cut and surrounded by others, and for ``unknown`` from windows of
the corpus itself and from pieces of notices amid other words.  A held-out part of the sample sets the
temperature of the chances and the least chance, which at most ``PASSED`` of the unknown windows reach.

Neighbouring windows with the same prediction are one place; the place and its surroundings are compared
with all notices.  Holding ``CONFIRM`` of the runs of a notice of its family confirms it, a smaller share
lowers the chance by its square, and a family whose notices fit worse than another's is dropped.

It learns from at most ``LEARN_LINES`` corpus documents, one window of one line of each, of at most
64 words and ``LEARN_SIGNS`` signs, so what the driver holds is bounded; scanning reads every word.

Defined results: null or empty text has no paragraphs and no licence.  Repeated
rows get equal results.  Other columns are not read, whatever their names.  Texts of any length are
judged whole; memory grows with the longest text.  Without any corpus lines ``unknown`` is learned
from pieces of notices alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtrail.llm.common import slices, utf8
from sealtrail.llm.words import FACTOR, mixed, word_hashes

# Fixed: notices that the licences' own texts ask for or begin with.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Distributed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Distributed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met.",
        "SPDX-License-Identifier: BSD",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "GPL": (
        "Licensed under the GNU General Public License, Version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, Version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
        " Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, Version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "public-domain": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    # What stands between the lines of a notice differs from owner to owner.
    "all-rights-reserved": ("Copyright\nAll rights reserved.",),
}
# Fixed: notices that count only as a line of their own.
WHOLE_LINES: dict[str, tuple[str, ...]] = {"all-rights-reserved": ("All rights reserved.",)}
UNKNOWN = "unknown"
CLASSES = (*NOTICES, UNKNOWN)

SLOTS = 1 << 15
SIZES = (8, 16, 32, 64)
LEARN_LINES = 4000
LEARN_SIGNS = 2000
VARIANTS = 60
EPOCHS = 5
PASSED = 0.005
CONFIRM = 0.8

_OPENS, _CLOSES = 0x5851F42D4C957F2D, 0x14057B7EF767814F
_NOT_WORD = np.array([not (chr(b).isascii() and chr(b).isalnum()) and b < 128 for b in range(256)])


def lines(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines (one more than lines), and the text each belongs to."""
    breaks = np.flatnonzero(raw == 10) + 1
    begin = np.unique(np.concatenate([starts[:-1], breaks[breaks < len(raw)]]))
    begin = begin[begin < len(raw)]
    return np.append(begin, len(raw)), np.searchsorted(starts, begin, "right") - 1


def paragraphs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all paragraphs (one more than paragraphs), and the text each belongs to."""
    bounds, text = lines(raw, starts)
    if not len(text):
        return bounds, text
    total = np.concatenate([[0], np.cumsum(~_NOT_WORD[raw])])
    blank = total[bounds[1:]] == total[bounds[:-1]]
    first = np.append(True, (text[1:] != text[:-1]) | blank[:-1])
    return np.append(bounds[:-1][first], len(raw)), text[first]


@dataclass
class Words:
    """The words of some texts: hashes, paragraph of each, and the runs that begin at each word (0 where none does)."""

    word: np.ndarray
    inside: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    opens: np.ndarray
    closes: np.ndarray

    def __len__(self) -> int:
        return len(self.word)

    def runs(self) -> tuple[np.ndarray, ...]:
        return self.word, self.pair, self.triple, self.opens, self.closes


def words_of(raw: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of texts that begin at ``starts``, in paragraphs that begin at ``bounds``."""
    begin, _, word, inside = word_hashes(raw, bounds, _NOT_WORD)
    line = np.searchsorted(lines(raw, starts)[0], begin, "right")
    pair, triple = np.zeros_like(word), np.zeros_like(word)
    one = mixed(word[:-1] * np.uint64(FACTOR) + word[1:])
    pair[:-1] = np.where(inside[1:] == inside[:-1], one, 0)
    if len(word) > 2:
        triple[:-2] = np.where(inside[2:] == inside[:-2], mixed(one[:-1] * np.uint64(FACTOR) + word[2:]), 0)
    other = np.append(True, line[1:] != line[:-1]) if len(word) else np.zeros(0, bool)
    opens = np.where(other, mixed(word ^ np.uint64(_OPENS)), 0)
    closes = np.where(np.append(other[1:], True)[: len(word)], mixed(word ^ np.uint64(_CLOSES)), 0)
    return Words(word, inside, pair, triple, opens, closes)


def _words(texts: list[bytes]) -> Words:
    """Words of texts of which each is one paragraph."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return words_of(np.frombuffer(b"".join(texts), np.uint8), starts, starts)


def _template(notice: str, whole_line: bool) -> np.ndarray:
    """Two-word runs within each line of a notice, lines of one word as such; of a whole line also how it begins and ends."""
    out = []
    for text in notice.split("\n"):
        w = _words([text.encode()])
        out += [w.pair[:-1] if len(w) > 1 else w.word]
        out += [w.opens[:1], w.closes[-1:]] if whole_line else []
    return np.unique(np.concatenate(out))


_TEMPLATES = [
    (CLASSES.index(family), _template(notice, whole))
    for whole, table in ((False, NOTICES), (True, WHOLE_LINES))
    for family, notices in table.items()
    for notice in notices
]


class Scanner:
    def __init__(self) -> None:
        self.weights = np.zeros((SLOTS, len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)
        self.temperature = 1.0
        self.least = 0.5

    def scores(self, words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Linear scores of the windows of words, scaled to their number of runs."""
        total = np.zeros((len(words) + 1, len(CLASSES)))
        count = np.zeros(len(words) + 1)
        for run in words.runs():
            total[1:] += self.weights[_slots(run)] * (run != 0)[:, None]
            count[1:] += run != 0
        np.cumsum(total, 0, out=total)
        np.cumsum(count, out=count)
        share = 1 / np.sqrt(np.maximum(count[end] - count[begin], 1))
        return (total[end] - total[begin]) * share[:, None] + self.bias

    def chances(self, scores: np.ndarray) -> np.ndarray:
        x = np.exp((scores - scores.max(1, keepdims=True)) / self.temperature)
        return x / x.sum(1, keepdims=True)

    def learn(self, texts: list[bytes], labels: np.ndarray, seed: int = 9) -> None:
        """Stochastic gradients on four fifths; the rest calibrates."""
        random = np.random.default_rng(seed)
        order = random.permutation(len(texts))
        cut = len(texts) * 4 // 5
        words = _words(texts)
        runs = np.stack(words.runs(), 1)
        first = np.searchsorted(words.inside, np.arange(len(texts) + 1))
        slots = [(lambda r: _slots(r[r != 0]))(runs[a:b]) for a, b in zip(first[:-1], first[1:])]
        for epoch in range(EPOCHS):
            rate = 0.3 / (1 + epoch)
            for at in range(0, cut, 32):
                chosen = order[:cut][at : at + 32]
                sizes = np.array([len(slots[i]) for i in chosen])
                slot, owner = np.concatenate([slots[i] for i in chosen]), np.repeat(np.arange(len(chosen)), sizes)
                share = 1 / np.sqrt(np.maximum(sizes, 1))
                held = np.zeros((len(chosen), len(CLASSES)))
                np.add.at(held, owner, self.weights[slot])
                error = self.chances(held * share[:, None] + self.bias)
                error[np.arange(len(chosen)), labels[chosen]] -= 1
                np.add.at(self.weights, slot, (-rate * error * share[:, None])[owner].astype(np.float32))
                self.bias -= (rate * error.mean(0)).astype(np.float32)
        rest = order[cut:]
        if not len(rest):
            return
        scores, truth = self.scores(words, first[rest], first[rest + 1]), labels[rest]

        def loss(temperature: float) -> float:
            self.temperature = temperature
            return -np.log(self.chances(scores)[np.arange(len(rest)), truth] + 1e-12).mean()

        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        known = self.chances(scores)[:, :-1].max(1)
        wrong = known[truth == len(CLASSES) - 1]
        passed = float(np.quantile(wrong, 1 - PASSED)) if len(wrong) else 0.0
        self.least = min(max(passed + 1e-6, 0.5), 0.9)

    def predicted(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last word, family and chance of the windows for which a family is predicted."""
        begin, end = windows(words.inside)
        chances = self.chances(self.scores(words, begin, end))
        family = chances.argmax(1)
        kept = (family < len(CLASSES) - 1) & (chances.max(1) >= self.least)
        return begin[kept], end[kept], family[kept], chances.max(1)[kept]

    def scan(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, paragraph, family and chance of every place that holds a notice."""
        bounds, text = paragraphs(raw, starts)
        words = words_of(raw, starts, bounds)
        found: list[tuple[int, int, int, float]] = []
        for begin, end, family, chance in places(words.inside, *self.predicted(words)):
            paragraph = words.inside[begin]
            low = max(begin - SIZES[-1], np.searchsorted(words.inside, paragraph))
            high = min(end + SIZES[-1], np.searchsorted(words.inside, paragraph, "right"))
            chance *= agreement(words, low, high, family)
            if chance >= self.least:
                found.append((text[paragraph], paragraph, family, chance))
        out = np.array(found).reshape(-1, 4)
        return out[:, 0].astype(np.int64), out[:, 1].astype(np.int64), out[:, 2].astype(np.int64), out[:, 3]


def _slots(run: np.ndarray) -> np.ndarray:
    return (run >> np.uint64(33)).astype(np.int64) % SLOTS


def windows(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of all windows; each word is in one of each size up to its paragraph's."""
    first = np.flatnonzero(np.append(True, inside[1:] != inside[:-1])) if len(inside) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(inside))
    begin, end = [], []
    for size in SIZES:
        step = size // 2
        # A paragraph that a smaller size holds whole needs no larger one.
        here = (last - first > step) | (size == SIZES[0])
        count = np.maximum(-(-(last - first - step) // step), 1)[here]
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin.append(np.repeat(first[here], count) + number * step)
        end.append(np.minimum(begin[-1] + size, np.repeat(last[here], count)))
    return np.concatenate(begin), np.concatenate(end)


def places(
    inside: np.ndarray, begin: np.ndarray, end: np.ndarray, family: np.ndarray, chance: np.ndarray
) -> Iterator[tuple[int, int, int, float]]:
    """Windows of one family that touch within a paragraph, joined; the chance is their best."""
    order = np.lexsort((begin, inside[begin], family))
    begin, end, family, chance = begin[order], end[order], family[order], chance[order]
    at = 0
    while at < len(begin):
        high, best, after = end[at], chance[at], at + 1
        while after < len(begin) and (family[after], inside[begin[after]]) == (family[at], inside[begin[at]]) and begin[after] <= high:
            high, best, after = max(high, end[after]), max(best, chance[after]), after + 1
        yield int(begin[at]), int(high), int(family[at]), float(best)
        at = after


def agreement(words: Words, low: int, high: int, family: int) -> float:
    """1 if a notice of the family is held, else the square of the held share; 0 if another family's notice is held there and fits better."""
    here = np.concatenate([r[low:high] for r in (words.word, words.pair, words.opens, words.closes)])
    at = np.tile(np.arange(high - low), 4)
    own, first, last = 0.0, 0, high - low
    for number, template in _TEMPLATES:
        if number == family:
            share, begin, end = _best_span(here, at, template)
            if share > own:
                own, first, last = share, begin, end
    # Words next to the span may belong to a longer notice, that of another family.
    near = (at >= first - 3) & (at <= last + 3)
    here, at = here[near], at[near]
    other = max(_best_span(here, at, template)[0] for number, template in _TEMPLATES if number != family)
    if other >= CONFIRM and other > own:
        return 0.0
    return 1.0 if own >= CONFIRM else own**2


def _best_span(here: np.ndarray, at: np.ndarray, template: np.ndarray) -> tuple[float, int, int]:
    """The largest share of a notice's runs within a span of at most twice the notice and eight words, and that span."""
    hits = np.flatnonzero(np.isin(here, template))
    if not len(hits):
        return 0.0, 0, 0
    hits = hits[np.argsort(at[hits], kind="stable")]
    which, place = np.searchsorted(template, here[hits]), at[hits]
    close = np.searchsorted(place, place + 2 * (len(template) + 1) + 6, "right")
    held = np.array([len(np.unique(which[i:j])) for i, j in enumerate(close)])
    best = int(held.argmax())
    return held[best] / len(template), int(place[best]), int(place[close[best] - 1])


def _learnt_line(text: str) -> bool:
    """Whether a corpus line is an example of the unknown class: it holds less than half of any notice."""
    w = _words([text.encode()])
    here = np.concatenate([w.word, w.pair, w.opens, w.closes])
    return all(np.isin(t, here).mean() < 0.5 for _, t in _TEMPLATES)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 8) -> Scanner:
    """Learn from the notices and a bounded sample of windows of corpus lines."""
    random = np.random.default_rng(seed)
    chosen = docs.select(F.col(doc_id).alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(LEARN_LINES)
    pick = lambda n, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.greatest(n, F.lit(1))).cast("int")
    lines_ = F.split(F.col("_text"), "\n")
    spaced = F.split("line", " +")
    window = F.array_join(F.slice(spaced, pick(F.size(spaced), 2) + 1, 4 + pick(F.lit(SIZES[-1] - 4), 3)), " ")
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
        .join(F.broadcast(chosen.distinct()), "_id", "left_semi")
        .select("_id", F.get(lines_, pick(F.size(lines_), 1)).alias("line"))
        .select(F.substring(window, 1, LEARN_SIGNS).alias("line"))
        .where(F.length("line") > 0).limit(2 * LEARN_LINES).toPandas()["line"]
    )
    corpus = [x.encode() for x in sorted(rows) if _learnt_line(x)]
    filler = [w for x in corpus[:500] for w in x.split()[:20]] or [b"the", b"of", b"and"]
    texts, labels = list(corpus), [len(CLASSES) - 1] * len(corpus)

    def some(most: int, least: int = 0) -> list[bytes]:
        return [filler[i] for i in random.integers(0, len(filler), random.integers(least, most))]

    def add(line: bytes, label: int) -> None:
        texts.append(line.upper() if random.random() < 0.1 else line)
        labels.append(label)

    for whole, table in ((False, NOTICES), (True, WHOLE_LINES)):
        for family, notices in table.items():
            for words in (n.encode().replace(b"\n", b" \n ").split(b" ") for n in notices):
                for _ in range(VARIANTS):
                    if whole:
                        before, after = some(12), some(12)
                        parts = [b" ".join(x) for x in (before, words, after) if x]
                        add(b"\n".join(parts), CLASSES.index(family))
                        add(b" ".join([*some(12, 2), *words, *some(12, 2)]), len(CLASSES) - 1)
                        continue
                    kept = [some(4) if w == b"\n" else [w] for w in words if w == b"\n" or random.random() > 0.1 or len(words) < 6]
                    glue = b"\n" if random.random() < 0.3 else b" "
                    middle = b" ".join(w for part in kept for w in part)
                    add(glue.join(b" ".join(x) for x in (some(14), [middle], some(14)) if x), CLASSES.index(family))
                # One or two words of a notice amid others are none, unless they are half of one.
                for _ in range(VARIANTS // 2):
                    piece = [w for w in words if w != b"\n"]
                    at = random.integers(0, len(piece))
                    line = b" ".join([*some(14, 3), *piece[at : at + random.integers(1, 3)], *some(14, 3)])
                    if _learnt_line(line.decode("utf-8", "replace")):
                        add(line, len(CLASSES) - 1)
    scanner = Scanner()
    scanner.learn(texts, np.array(labels))
    return scanner


def licences(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, licences (sorted, comma-joined; null if none), n_paragraphs, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            names: list[set[str]] = [set() for _ in range(n)]
            counts, best = np.zeros(n, np.int64), np.zeros(n)
            before = -1
            for row, paragraph, family, sure in sorted(zip(*scanner.scan(*utf8(batch.column(1))))):
                names[row].add(CLASSES[family])
                counts[row] += paragraph != before
                before = paragraph
                best[row] = max(best[row], sure)
            joined = [",".join(sorted(x)) if x else None for x in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(joined, pa.string()), pa.array(counts), pa.array(best)],
                ["doc_id", "licences", "n_paragraphs", "score"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, licences string, n_paragraphs long, score double")
