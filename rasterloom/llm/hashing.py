"""Hashes of many slices of one byte array, from prefix sums.

Polynomials modulo the prime 2^31 - 1 at two bases. (Modulo 2^64, texts such as the Thue-Morse
word and its complement share a hash at every odd base.)
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
_U = np.uint64
_P, _SHIFT = _U(PRIME), _U(31)
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, PRIME, (2, 256), dtype=np.uint64)
_BASES = _RNG.integers(1 << 20, PRIME, 2).tolist()
_POWERS = [[np.ones(1, _U), np.ones(1, _U)] for _ in _BASES]  # of each base: its powers and those of its inverse


def _reduced(x: np.ndarray) -> np.ndarray:
    """x < 2^63 modulo the prime, up to one prime too much."""
    return (x & _P) + (x >> _SHIFT)


def _powers(which: int, n: int) -> list[np.ndarray]:
    """The first n powers or more, kept for later calls."""
    for inverse, base in ((0, _BASES[which]), (1, pow(_BASES[which], -1, PRIME))):
        have = _POWERS[which][inverse]
        while len(have) < n:
            have = np.concatenate((have, have * _U(pow(base, len(have), PRIME)) % _P))
        _POWERS[which][inverse] = have
    return _POWERS[which]


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each data[start:end], data being uint8."""
    n, out = len(data), np.zeros(len(start), _U)
    for which in (0, 1):
        up, down = _powers(which, n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_reduced(_BYTES[which][data] * up[:n]), out=total[1:])
        here = (total[end] - total[start]) % _P * down[start] % _P
        out = out << _SHIFT | here
    return out
