"""Words of whole batches as hash arrays, without per-row string calls."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

from plenaria.llm.lookalikes import canonical_points

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@functools.cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 for letters and numbers, 2 for apostrophes, else 0; and its lower case (where that is one character)."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            kind[c] = 1
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[c] = ord(low)
    kind[[0x27, 0x2019]] = 2
    return kind, lower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)


def _spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which code points are inside of words, and where words start."""
    k = classes()[0][points]
    letter = k == 1
    # an apostrophe belongs to a word if a letter of the same row stands on either side
    ends = np.zeros(len(points) + 1, bool)
    ends[offsets] = True
    joint = np.flatnonzero(k == 2)
    joint = joint[(joint > 0) & (joint < len(points) - 1)]
    joint = joint[letter[joint - 1] & letter[joint + 1] & ~ends[joint] & ~ends[joint + 1]]
    inside = letter
    inside[joint] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    return inside, np.flatnonzero(inside & (~before | ends[:-1]))


def word_counts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each row's text as stored."""
    return np.diff(np.searchsorted(_spans(points, offsets)[1], offsets))


def word_hashes(points: np.ndarray, offsets: np.ndarray, form: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all rows' words in order, and the rows' offsets in them.

    Words are those of SURVEY S1, after problem 4's form (if asked for) and without letter case.
    """
    if form:
        points, offsets = canonical_points(points, offsets)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lower = classes()[1]
    inside, starts = _spans(points, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    index = np.flatnonzero(inside)
    first = np.searchsorted(index, starts)
    place = np.arange(len(index)) - np.repeat(first, np.diff(np.append(first, len(index))))
    power = _powers(1 << int(place.max()).bit_length())
    values = (lower[points[index]].astype(np.uint64) + np.uint64(1)) * power[place]
    hashes = mix(np.add.reduceat(values, first))
    return hashes, np.searchsorted(starts, offsets)


def occurrence_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of (word, its how-many-eth occurrence in the row), so that bags become sets; in the order of the words."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    out = np.empty_like(hashes)
    out[order] = mix(h + nth.astype(np.uint64) * BASE)
    return out
