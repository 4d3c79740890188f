"""Letters, words and hashed n-gram features of many texts at once, in NumPy."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Words:
    """The words (runs of letters, in lower case) of texts, as arrays over the letters and over the words."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("\0".join(lower).encode("utf-32-le", "surrogatepass") if lower else b"", "<u4")
        mask = letters()[codes]
        lengths = np.array([len(t) for t in lower], np.int64)
        text_ends = np.cumsum(lengths + 1)
        at = np.flatnonzero(mask)
        self.c = codes[at]
        new = np.empty(len(at), bool)
        if len(at):
            new[0] = True
            np.not_equal(np.diff(at), 1, out=new[1:])
        self.starts = np.flatnonzero(new)  # of words, among the letters
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.text = np.searchsorted(text_ends, at[self.starts], "right")  # of each word
        self.counts = np.bincount(self.text, minlength=len(texts))  # words of each text
        self.place = (np.arange(len(at)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.rest = np.repeat(self.sizes.astype(np.int32), self.sizes) - self.place

    def grams(self, n: int, bits: int) -> np.ndarray:
        """For each letter the feature number, from 1 to 2**bits, of the n letters from it on; 0 where the word ends before. The word's first and last n letters are features of their own."""
        h = self.c * np.uint32(2654435761)
        for k in range(1, n):
            h[:-k] = (h[:-k] ^ self.c[k:]) * np.uint32(0x9E3779B1 + 2 * k) if k < len(h) else h[:-k]
        h ^= (self.place == 0).astype(np.uint32) * np.uint32(0x5BD1E995) + (self.rest == n).astype(np.uint32) * np.uint32(0x1B873593) + np.uint32(0x27D4EB2F * n & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        return np.where(self.rest >= n, (h >> np.uint32(32 - bits)).astype(np.int32) + 1, 0)

    def whole(self, bits: int) -> np.ndarray:
        """For each word the feature number, from 1 to 2**bits, of the whole word."""
        if not len(self.starts):
            return np.empty(0, np.int32)
        factor = np.power(np.uint64(0x100000001B3), np.minimum(self.place, 63).astype(np.uint64), dtype=np.uint64)
        h = np.add.reduceat((self.c.astype(np.uint64) + np.uint64(0x9E37)) * factor, self.starts) ^ self.sizes.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - bits)).astype(np.int32) + 1

    def sum_by_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over each word's letters."""
        return np.add.reduceat(values, self.starts, axis=0) if len(self.starts) else values[:0]
