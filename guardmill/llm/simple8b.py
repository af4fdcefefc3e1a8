"""Simple-8b: whole numbers packed into 64-bit words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values: (numbers per word, bits per number) of selectors 0 to 15.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_MOST = int(_COUNTS.max())
#: Numbers from here on don't fit a word; they escape to a list of their own.
ESCAPE = 1 << 60


@dataclass(frozen=True)
class Block:
    """Packed words, and the escaped numbers with their places."""

    n: int
    words: np.ndarray
    places: np.ndarray
    escaped: np.ndarray


def encode(values: np.ndarray) -> Block:
    """Packs non-negative numbers; each word takes as many of the next ones as it can."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    places = np.flatnonzero(values >= np.uint64(ESCAPE))
    escaped = values[places]
    padded = np.zeros(n + _MOST, dtype=np.uint64)
    padded[:n] = values
    padded[places] = 0
    selectors, starts = _choose(padded, n)
    words = np.empty(len(starts), dtype=np.uint64)
    for s in np.unique(selectors):
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(selectors == s)
        word = np.full(len(rows), np.uint64(int(s) << 60), dtype=np.uint64)
        if bits:
            for j in range(count):
                word |= padded[starts[rows] + j] << np.uint64(j * bits)
        words[rows] = word
    return Block(n, words, places.astype(np.uint32), escaped)


def _choose(padded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The selector of every word and the place of its first number."""
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(n, dtype=np.int32)
    best = np.full(n, len(SELECTORS) - 1, dtype=np.int8)
    # the bits of every number; above 2^53 perhaps one too many, which is only less tight
    need = np.minimum(np.frexp(padded[:n].astype(np.float64))[1], 60).astype(np.int8)
    fitting = np.cumsum(np.bincount(need, minlength=61))
    limits: dict[int, np.ndarray] = {}
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        # so many in a row may only be had beyond the end, where zeros follow
        if fitting[bits] < count and not need[-1] <= bits:
            continue
        if bits not in limits:
            wide = np.where(need > bits, at, np.int32(n + _MOST))
            limits[bits] = np.minimum.accumulate(wide[::-1])[::-1]
        best[limits[bits] - at >= count] = s
    step = _COUNTS[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts, dtype=np.int64)
    return best[first], first


def decode(block: Block) -> np.ndarray:
    """All numbers of a block as unsigned 64-bit."""
    selectors = (block.words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    ends = np.cumsum(counts)
    room = int(ends[-1]) if len(ends) else 0
    if room < block.n:
        raise ValueError("the words hold fewer numbers than stated")
    starts = ends - counts
    out = np.zeros(room, dtype=np.uint64)
    for s in np.unique(selectors):
        count, bits = SELECTORS[s]
        if not bits:
            continue
        rows = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[starts[rows] + j] = (block.words[rows] >> np.uint64(j * bits)) & mask
    out = out[:block.n]
    out[block.places] = block.escaped
    return out
