"""The binary Golay code [23, 12, 7] as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one codeword. A word's indices are the 12-bit numbers of the codewords
within 4 bits of it: one, or six where the nearest is 3 away. Two words that differ in at most two bits always share
one (tests go through all of them), so equal indices find all such pairs.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
TOLERANCE = 2


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of the upper 12 bits; by syndrome six error patterns of at most 4 bits (the first repeated if there is one); how many there are."""
    bit = [remainder(1 << b) for b in range(23)]
    upper = np.array([remainder(i << 11) for i in range(1 << 12)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for k in range(5):
        for places in combinations(range(23), k):
            syndrome = functools.reduce(lambda s, b: s ^ bit[b], places, 0)
            found[syndrome].append(sum(1 << b for b in places))
    return upper, np.array([(x * 6)[:6] for x in found], np.int64), np.array([len(x) for x in found], np.int64)


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six codeword indices, and how many of them, from the left, are its own."""
    upper, patterns, count = tables()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]
