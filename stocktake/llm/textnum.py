"""Words and word shingles of texts as 64-bit numbers, computed with numpy.

A word is a run of letters and digits of the lower-cased text.  Its number is a
polynomial hash of its code points, taken from prefix sums over the whole
slice, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


@lru_cache(1)
def word_chars() -> np.ndarray:
    """For each code point, whether it belongs to words."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@lru_cache(1)
def _inverse() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _inverse())):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some texts.  ``hashes``: a number for each word.  Words of text
    ``i`` are ``offsets[i]:offsets[i + 1]``.  ``starts``, ``ends``: their places
    in ``joined``, where text ``i`` begins at ``begins[i]``."""

    def __init__(self, texts: Sequence[str], prefixes: Sequence[int] = ()) -> None:
        lowered = [t.lower() for t in texts]
        self.joined = "\n".join(lowered) + "\n"
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
        self.begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = word_chars().take(codes, mode="clip")  # no bounds to check
        change = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        power, inverse = _power(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
        first = sums[self.starts]
        scale = inverse[self.starts]
        self.hashes = mix((sums[self.ends] - first) * scale)
        self.offsets = np.searchsorted(self.starts, self.begins)
        sizes = self.ends - self.starts
        #: for each length k, the number of the first k letters (0: shorter words)
        self.prefix = {k: np.where(sizes >= k, mix((sums[np.minimum(self.starts + k, len(codes))] - first) * scale), np.uint64(0)) for k in prefixes}


def word_hash(word: str) -> int:
    """The number that ``Words`` gives this word."""
    return int(Words([word]).hashes[0])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``n`` words and each text's place among them.  A
    text of fewer words, but one at least, has one shingle of all its words."""
    h, offsets = words.hashes, words.offsets
    count = np.diff(offsets)
    keep = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    places = np.concatenate(([0], np.cumsum(keep)))
    out = np.zeros(places[-1], np.uint64)
    long = np.flatnonzero(count >= n)
    if len(h) >= n and len(long):
        full = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            full = full * _MIX + h[j : len(h) - n + 1 + j]
        full = mix(full)
        own = keep[long]
        index = np.repeat(offsets[long] - np.concatenate(([0], np.cumsum(own)))[:-1], own) + np.arange(own.sum())
        target = np.repeat(places[long] - np.concatenate(([0], np.cumsum(own)))[:-1], own) + np.arange(own.sum())
        out[target] = full[index]
    for i in np.flatnonzero((count > 0) & (count < n)):
        value = np.array([count[i]], np.uint64)
        for x in h[offsets[i] : offsets[i + 1]]:
            value = value * _MIX + x
        out[places[i]] = mix(value)[0]
    return out, places
