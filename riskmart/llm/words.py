"""Words of many texts at once, as positions in their UTF-8 bytes, and hashes of words and of windows of words.

A word is a run of bytes other than space and the controls from tab to carriage return. Hashes are polynomials modulo 2^64
over a table of random 64-bit values, taken from prefix sums (Rabin and Karp), then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240607)
#: A random value for each byte; two odd bases with their inverses modulo 2^64.
BYTE_VALUES = _rng.integers(0, 2**64, 256, np.uint64)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xFF51AFD7ED558CCD)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below n at least."""
    if len(_powers.get(base, ((), ()))[0]) < n:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        if n > 1 << 23:  # one very long text: not worth keeping
            return tuple(both)
        _powers[base] = tuple(both)
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """start, end: of each word in the bytes; first: of each text's words (n + 1 offsets)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def find(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    inside = ~separator[data]
    cut = offsets[1:-1]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[cut[cut < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each of the byte ranges, by its bytes alone."""
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(_BYTE_BASE, len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUES[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def windows(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of `size` consecutive words of one text."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _power(_WORD_BASE, len(word_hash))
    total = np.empty(len(word_hash) + 1, np.uint64)
    total[0] = 0
    np.cumsum(word_hash * up, out=total[1:])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return at, mix((total[at + size] - total[at]) * down[at])
