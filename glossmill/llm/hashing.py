"""Vectorised word and shingle hashes of one text, shared by Python operators."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_UP = _powers(1 << 16, _ODD)
_DOWN = _powers(1 << 16, _INVERSE)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(size, _ODD), _powers(size, _INVERSE)
    return _UP, _DOWN


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every white-space word, in order; A-Z lowered on request."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    starts, stops = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)])))
    return mix((sums[stops] - sums[starts]) * up[starts] + (stops - starts).astype(np.uint64) * _MIX1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; of all words if they are fewer."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _ODD + words[i : n - size + 1 + i]
    return mix(out)
