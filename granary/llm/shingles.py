"""Hashed word shingles inside tasks: NumPy helpers shared by the grouped Python operators."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Odd multipliers drawn by rule, one per place in a shingle.
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def finished(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multiplier(i: int) -> np.uint64:
    """Mixed, so that multipliers are in no progression: else ``a b b a`` and ``b a a b`` would hash alike."""
    return finished(np.array([(_STEP * (i + 1)) & _MASK], np.uint64))[0] | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each word."""
    if not words:
        return np.empty(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words, in order; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += hashes[i:i + n] * multiplier(i)
    return finished(out)


def rolling_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """As :func:`window_hashes` for wide windows: differences of one running polynomial."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = pow(_STEP, 1, 1 << 64)
    powers = np.cumprod(np.full(len(hashes) + 1, base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    inverse = pow(base, -1, 1 << 64)
    back = np.cumprod(np.full(n, inverse, np.uint64)) * np.uint64(base)
    return finished((sums[width:] - sums[:n]) * back)
