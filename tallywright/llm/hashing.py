"""Hashes of many slices at once, in numpy."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverse, modulo 2 ** 64, for i below n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        both = tuple(np.concatenate((np.ones(1, "u8"), np.cumprod(np.full(n + n // 4, p, "u8")))) for p in (PRIME, inverse))
        _POWERS[:] = [both]
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice of values, by prefix sums of a polynomial."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum((values.astype("u8") + np.uint64(1)) * up[: len(values)])))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype("u8"))


def salts(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype="u8") * PRIME)
