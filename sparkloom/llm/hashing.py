"""Stable 64-bit hashes in numpy, and a bitmap of fixed size that thins out rows before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

_U = np.uint64
#: Odd constants of a well-known 64-bit finalizer, and the base of the polynomial.
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


#: A random number for each byte.
BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse modulo 2**64, made on first use."""

    up = down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 17)
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up, cls.down


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+, in order. Works through long texts in blocks that end at a space."""
    out, start = [], 0
    while start < len(data):
        end = len(data)
        if end - start > _BLOCK:
            cuts = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, min(_BLOCK, end - start), start)])
            if len(cuts):
                end = start + int(cuts[-1]) + 1
            else:  # a word longer than a block: up to its end
                rest = np.frombuffer(data, np.uint8, end - start, start)
                cuts = np.flatnonzero(_SPACE[rest])
                end = start + int(cuts[0]) + 1 if len(cuts) else end
        out.append(_block_hashes(np.frombuffer(data, np.uint8, end - start, start)))
        start = end
    return np.concatenate(out) if out else np.empty(0, _U)


def _block_hashes(a: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Tables.of(len(a) + 1)
    total = np.zeros(len(a) + 1, _U)
    np.cumsum(BYTES[a] * up[: len(a)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(_U))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of windows of `width` words; fewer words, but not none, are one window."""
    if len(words) == 0:
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    x = np.zeros(n, _U)
    for i in range(k):
        x = mix(x * _C1 + words[i : i + n] + _U(i))
    return np.unique(x)


class Bitmap:
    """A set of 64-bit keys, kept as `probes` bits for each among 2**bits slots: it may hold too much, never too little.

    Where there are too many keys for its size, more rows pass and meet the exact join that must follow. Two probes take
    a key's lower and upper half, so its bits should be a hash's.
    """

    def __init__(self, words: np.ndarray, bits: int, probes: int = 1):
        self.words, self.bits, self.probes = words, bits, probes

    @staticmethod
    def bits_for(n: int) -> int:
        """Eight slots or more a key: 2 MB at least, 32 MB at most."""
        return min(28, max(24, (8 * n - 1).bit_length()))

    @classmethod
    def of(cls, keys: DataFrame, column: str, bits: int = 24, probes: int = 1) -> "Bitmap":
        if not 1 <= probes <= 2 or bits > 32:
            raise ValueError("a key has two halves of 32 bits")
        if probes == 2:
            keys = keys.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias(column))
        slot = F.col(column).bitwiseAND((1 << bits) - 1)
        got = keys.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(63).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas()
        words = np.zeros(1 << max(0, bits - 6), _U)
        words[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(_U)
        return cls(words, bits, probes)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for i in range(self.probes):
            slot = (keys.view(_U) >> _U(32 * i)) & _U((1 << self.bits) - 1)
            found &= (self.words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)) & _U(1)).astype(bool)
        return found
