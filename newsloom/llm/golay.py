"""The perfect binary Golay code of length 23: every 23-bit word is within 3 bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.array([_remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int32)
    error = np.zeros(1 << 11, np.int32)
    for k in range(1, 4):
        for bits in combinations(range(23), k):
            e = sum(1 << b for b in bits)
            error[_remainder(e)] = e
    return low, high, error


_LOW, _HIGH, _ERROR = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int32)
    return (words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """For each word the distinct indices of its own and its 23 neighbours' codewords: one, or six; -1 fills the rest.

    A word within 2 bits of its codeword has one, as all its neighbours decode alike. Two words that differ in one bit
    share an index, since each is a neighbour of the other.
    """
    flips = np.r_[0, 1 << np.arange(23)].astype(np.int32)
    found = np.sort(codeword_index(words.astype(np.int32)[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]
