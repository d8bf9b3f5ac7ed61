"""Hashed words and structure statistics of whole texts, for the two classifiers."""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np

#: A word cache is emptied at this size, so that a worker's memory stays bounded.
CACHE_WORDS = 100_000

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ASCII = bytes(range(128))
SIGNS = b"!#$%&*|<>{}[]=~^_@\\/"
BINS = 32


class HashedWords:
    """Word to bucket by CRC-32; remembers what it has hashed."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def ids(self, words: list[str]) -> list[int]:
        known, buckets, out = self.known, self.buckets, []
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets
            out.append(i)
        return out


def _bin(share: float, power: float = 0.5) -> int:
    """A share from 0 to 1 into BINS steps, finer near 0."""
    return min(BINS - 1, int(max(0.0, share) ** power * BINS))


def structure(text: str, words: list[str], counts: Counter) -> list[int]:
    """One bin for each statistic of a text's structure and for its lengths."""
    raw = text.encode("utf-8", "surrogatepass")
    n, size = max(1, len(words)), max(1, len(raw))
    without = lambda chars: 1 - len(raw.translate(None, chars)) / size
    top = counts.most_common(3)
    lines = raw.count(b"\n") + 1
    distinct_lines = len(set(raw.split(b"\n")))
    repeats = sum(map(operator.eq, words, words[1:]))
    return [
        min(BINS - 1, int(2 * np.log2(n + 1))), min(BINS - 1, int(2 * np.log2(lines))), min(BINS - 1, int(size / n)), _bin(len(counts) / n, 1), _bin(top[0][1] / n if top else 0),
        _bin(sum(c for _, c in top) / n), _bin(repeats / n), _bin(without(UPPER)), _bin(without(DIGITS)), _bin(without(SIGNS)), _bin(without(ASCII)) if size > 1 else 0,
        _bin(words.count("|") / n), _bin(1 - distinct_lines / lines), _bin(min(1.0, raw.count(b"!!") / n)), _bin(lines / n),
    ]


STRUCTURES = 15
