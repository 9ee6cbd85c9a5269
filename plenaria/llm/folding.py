"""Plain forms of short typed strings: no case, no accents, words only."""

from __future__ import annotations

import functools
import re
import unicodedata

# Letters that lose their mark by no decomposition.
UNMARKED = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
WORDS = re.compile(r"[^\W_]+")
# Fixed values: what stands for a missing value, in any letter case.
MISSING = ("", "0", "unknown", "none", "null", "n/a")


@functools.lru_cache(100_000)
def fold(text: str) -> str:
    """Lower case without accents."""
    out = unicodedata.normalize("NFKD", text).casefold().translate(UNMARKED)
    return "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return WORDS.findall(fold(text))


def grams(word: str) -> set[str]:
    """Letter pairs of a word, next to each other and one apart, with its ends marked: a swap or slip changes few of them."""
    padded = f"^{word}$"
    return {padded[k : k + 2] for k in range(len(padded) - 1)} | {padded[k] + padded[k + 2] for k in range(len(padded) - 2)}


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            n = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            row.append(n)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)
