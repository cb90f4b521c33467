"""Vectorised 64-bit hashing of words, shingles and byte windows; all arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n; kept and grown by the process."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s], times ``unshift`` at s, the polynomial hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def unshift(n: int) -> np.ndarray:
    return powers(_INVERSE, n)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * unshift(len(sums) - 1)[start] + size * np.uint64(0xD6E8FEB86659FD93))
