"""Polynomial hashes over byte buffers, vectorised.

The hash of bytes [i, j) is sum of byte[k] * B ** (k - i) modulo 2 ** 64.  Prefix
sums of byte[k] * B ** k give it as (P[j] - P[i]) * B ** -i: B is odd, so it has an
inverse.  Equal strings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.multiply.accumulate(held)
        if size <= 1 << 22:
            _POWERS[int(base)] = held
    return held[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P[0..n] of a byte array."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) for arrays of positions."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
