"""Vectorised hashing of words and word shingles (numpy, no per-word Python).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after A-Z are
lower-cased.  A text is read whole; texts are concatenated into segments of
about ``SEGMENT`` bytes that end at white space, so memory stays bounded for
texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SEGMENT = 1 << 20
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _constants(n: int, seed: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix64(steps) | _U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one segment: mixed sums of mixed (place, byte) pairs."""
    blank = _BLANK[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = not blank[0]
    edge[-1] = not blank[-1]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, length = at[0::2], at[1::2] - at[0::2]
    ends = np.cumsum(length)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    sums = np.zeros(len(place) + 1, dtype=_U)
    np.cumsum(mix64(place.astype(_U) << _U(8) | _LOWER[data[~blank]]), out=sums[1:])
    return mix64(sums[ends] - sums[ends - length] + length.astype(_U)), start


def _segments(data: np.ndarray) -> Iterable[tuple[int, int]]:
    """Cuts at white space, about every SEGMENT bytes (later, if a word is longer)."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n:
            near = np.flatnonzero(_BLANK[data[stop : stop + SEGMENT]])
            if len(near):
                stop += int(near[0]) + 1
                break
            stop = min(n, stop + SEGMENT)
        yield at, stop
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and words per text."""
    if not texts:
        return np.empty(0, _U), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for lo, hi in _segments(data):
        found, start = _segment_words(data[lo:hi])
        hashes.append(found)
        first = int(np.searchsorted(begins, lo, side="right")) - 1
        last = int(np.searchsorted(begins, hi - 1, side="right")) - 1
        cut = np.searchsorted(start + lo, begins[first : last + 2])
        cut[0], cut[-1] = 0, len(start)
        counts[first : last + 1] += np.diff(cut)
    return (np.concatenate(hashes) if hashes else np.empty(0, _U)), counts


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct shingles of each text, sorted by text
    then hash, and the size of each text's set.

    A text of 1 to ``words - 1`` words has its whole sequence as its one
    shingle; a text without words has the empty set.
    """
    hashes, counts = word_hashes(texts)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), made)
    if not len(owner):
        return np.empty(0, _U), owner, np.zeros(len(texts), np.int64)
    factor = _constants(words, 99)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    first = np.repeat(begin, made) + inner
    width = np.repeat(np.minimum(counts, words), made)
    total = width.astype(_U)
    padded = np.concatenate((hashes, np.zeros(words, _U)))
    for i in range(words):
        total += np.where(width > i, padded[first + i], _U(0)) * factor[i]
    total = mix64(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), dtype=bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[keep], owner[keep]
    return total, owner, np.bincount(owner, minlength=len(texts))
