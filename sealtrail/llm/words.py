"""Words of many texts at once, as hashes."""

from __future__ import annotations

import numpy as np

_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z as a-z
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int, size: int) -> np.ndarray:
    out = np.full(size, factor, np.uint64)
    if size:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(
    raw: np.ndarray, starts: np.ndarray, space: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of every word, and the text that it belongs to.

    A word is a run of bytes outside ``space`` within one text; its hash is a
    polynomial in its bytes, with A-Z read as a-z.
    """
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~space[raw]
    edges = np.diff(inside)
    first, last = edges[:-1] == 1, edges[1:] == -1
    if len(raw):
        # A text's start also begins a word, and ends the one before.
        cuts = starts[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        whole = cuts[(inside[1:-1][cuts] == 1) & (inside[1:-1][cuts - 1] == 1)]
        first[whole], last[whole - 1] = True, True
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = _powers(FACTOR, len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * powers, dtype=np.uint64)])
    back = _powers(pow(FACTOR, -1, 1 << 64), len(raw))
    word = mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return begin, end, word, np.searchsorted(starts, begin, "right") - 1
