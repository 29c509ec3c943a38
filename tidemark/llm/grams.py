"""Vectorised hashes of byte substrings, shared by the operators on raw text."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a fixed bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every substring of `length` bytes, by doubling."""
    part, size = raw.astype(np.uint64) + _U(1), 1
    out, done, left = None, 0, length
    while True:
        if left & 1:
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = out[:n] * _U(pow(BASE, size, 1 << 64)) + part[done:]
            done += size
        left >>= 1
        if not left:
            return out[: max(0, len(raw) - length + 1)]
        part = part[: len(part) - size] * _U(pow(BASE, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = np.full((-(-len(x) // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[: len(x)] = x
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
