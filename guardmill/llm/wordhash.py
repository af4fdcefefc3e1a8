"""64-bit hashes of words and word sequences, computed on whole byte arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. Its hash takes in 8 bytes at a time: each step is a bijection of 64 bits,
so words of one length up to 8 bytes never collide, and two longer ones of one length don't
when they differ in one step alone. Words of more than LONG bytes, and with `strong` all of
them, are hashed with BLAKE2b. Two given words collide with a chance of about 2^-64 unless
they were made for it. A sequence's hash is a polynomial of its words' hashes modulo 2^64:
sequences of up to 64 words keep 38 bits of that chance in the worst arrangement (the word
pattern that swaps and repeats itself). Working memory is that of one chunk, whatever the
length of a text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np

CHUNK = 1 << 20
#: Bytes of a word from which BLAKE2b takes over.
LONG = 256
_WORDS_BASE = 0xD1342543DE82EF95
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: The lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i in 0..n modulo 2^64."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        run = np.full(n + 1, factor, dtype=np.uint64)
        run[0] = 1
        out.append(np.cumprod(run, dtype=np.uint64))
    return out[0], out[1]


def _room(n: int) -> int:
    return max(1 << 16, 1 << (max(1, n) - 1).bit_length())


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                base: int) -> np.ndarray:
    """For each window the polynomial of its values, independent of where it lies."""
    power, inverse = _powers(base, _room(len(values)))
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def _chunk_words(data: np.ndarray, fold: bool, strong: int) -> tuple[np.ndarray, np.ndarray]:
    filled = np.empty(len(data) + 2, dtype=bool)
    filled[0] = filled[-1] = False
    np.logical_not(_IS_BLANK[data], out=filled[1:-1])
    edges = np.flatnonzero(filled[1:] != filled[:-1])
    starts, ends = edges[::2], edges[1::2]
    body = np.zeros(len(data) + 8, dtype=np.uint8)
    body[:len(data)] = _FOLDED[data] if fold else data
    lengths = ends - starts
    slow = np.full(len(starts), bool(strong)) if strong else lengths > LONG
    hashes = fast_hashes(body, starts, np.where(slow, 0, lengths))
    for i in np.flatnonzero(slow).tolist():
        digest = hashlib.blake2b(body[starts[i]:ends[i]].tobytes(), digest_size=8,
                                 salt=strong.to_bytes(4, "little")).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, starts


def fast_hashes(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of `body` at `starts`; 8 bytes lie behind the last word."""
    eights = np.ndarray(len(body) - 7, dtype="<u8", buffer=body.data, strides=(1,))
    hashes = mixed(lengths.astype(np.uint64) * np.uint64(_WORDS_BASE))
    live = np.flatnonzero(lengths)
    at, left = starts[live], lengths[live]
    while len(live):
        taken = eights[at] & _LOWEST[np.minimum(left, 8)]
        hashes[live] = mixed((hashes[live] ^ taken) + np.uint64(_STEP))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashes


def hash_words(data: bytes, fold: bool = False,
               strong: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; `fold` takes A-Z as a-z. With a number other than 0
    for `strong` all words are hashed with BLAKE2b, differently for every number."""
    whole = np.frombuffer(data, dtype=np.uint8)
    hashes, places, at = [], [], 0
    while at < len(whole):
        end = min(len(whole), at + CHUNK)
        if end < len(whole):
            blanks = np.flatnonzero(_IS_BLANK[whole[at:end]])
            while not len(blanks) and end < len(whole):  # a word longer than a chunk
                end = min(len(whole), end + CHUNK)
                blanks = np.flatnonzero(_IS_BLANK[whole[at:end]])
            if len(blanks) and end < len(whole):
                end = at + int(blanks[-1]) + 1
        hashed, starts = _chunk_words(whole[at:end], fold, strong)
        hashes.append(hashed)
        places.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def hash_texts(texts: Sequence[bytes], fold: bool = False,
               strong: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and where each text's words begin
    (one entry more than texts)."""
    words, places = hash_words(b" ".join(texts), fold, strong)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    return words, np.searchsorted(places, begins).astype(np.int64)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` words from each start."""
    sums = window_sums(words, starts, starts + n, _WORDS_BASE)
    return mixed(sums + np.uint64(n))


def window_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `n` words that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(owner)) - first[owner] + bounds[:-1][owner], owner
