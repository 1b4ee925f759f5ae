"""Words and word hashes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D. Its 64-bit hash is a polynomial in the bytes with
random coefficients, taken from prefix sums modulo 2^64, then mixed. Two different words share a hash with a
chance of about 2^-50 or less.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_517)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_COEFFICIENTS = _RNG.integers(1 << 62, (1 << 63) - 1, 256).astype(np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once, so that memory does not follow the length of a text.
_SEGMENT = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixing (two multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of words before it (one more at the end)."""
    inside = ~_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = _COEFFICIENTS[_LOWER] if lower else _COEFFICIENTS
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right")))
        base, part = starts[at], data[starts[at] : ends[stop - 1]]
        powers = np.full(len(part), _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers, out=sums[1:])
        back = np.full(len(part), _INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[e] - sums[s]) * back[s]
        at = stop
    return mix(out)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    starts, ends, counts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = mix(rolled, 1)
    sets = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if b - a >= width:
            found = np.sort(rolled[a : b - width + 1])
            found = found[np.r_[True, found[1:] != found[:-1]]]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in words[a:b]:
                whole = whole * _STEP + h
            found = mix(whole, 2 + b - a)
        else:
            found = np.zeros(0, np.uint64)
        sets.append(found)
    return sets
