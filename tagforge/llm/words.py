"""Words of blocks of whole texts as arrays: UTF-8 bytes end to end, word bounds, and 64-bit word keys.

Keys are polynomial in the word's bytes modulo 2**64 over random byte values, then mixed; A-Z count as a-z.  They tell words
apart inside a task; between tasks words are told apart by their bytes.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random value for every byte; capitals share that of their small letters.
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[65:91] = VALUE[97:123]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: The six white-space characters between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def bounds(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs where ``space`` is false; the first and last element must be true."""
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    return turn[::2], turn[1::2]


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One key per word data[start:end]."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * _power("up", BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", BASE_INVERSE, len(data))[starts])


def runs(order: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    return np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.zeros(0, np.int64)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs (or the sum of its weights)."""
    if weights is None:
        order = np.sort(values)
        first = runs(order)
        return order[first], np.diff(np.append(first, len(order)))
    at = np.argsort(values, kind="stable")
    order = values[at]
    first = runs(order)
    return order[first], np.add.reduceat(weights[at], first) if len(first) else weights[:0]
