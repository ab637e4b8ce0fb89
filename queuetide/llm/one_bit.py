"""One-bit codes of rotated vectors, and intervals that surely hold an inner product.

A vector is rotated and coded by the signs of its entries. The code vector b (signs over
the root of the dimension) has unit length; the stored alignment a = <b, rotated vector>
is how much of the vector lies along it. What is left, the residual, is rotated by
another matrix and coded again, ``LEVELS`` times in all, so x = sum of a_l * b_l + r. Then

    <q, x> = sum of a_l * <q, b_l> + <q, r>   with   |<q, r>| <= |q| |r|  (Cauchy-Schwarz)

The query side is rounded to ``QUERY_BITS`` bits per entry, so that <q, b_l> is a sum of
popcounts; the length of its rounding error is known and widens the interval.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LEVELS, QUERY_BITS, SEED = 5, 6, 11
_SLACK = 1e-12  # for the rounding of doubles, in lengths of the two vectors and per dimension


@lru_cache(maxsize=8)
def rotations(dim: int, levels: int = LEVELS, seed: int = SEED) -> list[np.ndarray]:
    draw = np.random.default_rng([seed, dim])
    return [np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(levels)]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as 64-bit words."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


@dataclass
class Codes:
    """``words`` [rows, levels, words of a code], ``along`` [rows, levels], lengths of residuals and vectors."""

    words: np.ndarray
    along: np.ndarray
    residual: np.ndarray
    length: np.ndarray


def encode(x: np.ndarray) -> Codes:
    n, dim = x.shape
    left, words, along = x.copy(), [], []
    for turn in rotations(dim):
        y = left @ turn.T
        plus = y >= 0
        a = np.abs(y).sum(axis=1) / np.sqrt(dim)
        left -= a[:, None] * (np.where(plus, 1.0, -1.0) / np.sqrt(dim) @ turn)
        words.append(_words(plus))
        along.append(a)
    return Codes(np.stack(words, axis=1), np.stack(along, axis=1), np.linalg.norm(left, axis=1), np.linalg.norm(x, axis=1))


class Queries:
    """Rounded rotated queries as bit planes."""

    def __init__(self, q: np.ndarray):
        self.dim = q.shape[1]
        self.length = np.linalg.norm(q, axis=1)
        self.levels = []
        for turn in rotations(self.dim):
            z = q @ turn.T
            low = z.min(axis=1)
            step = np.maximum((z.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
            u = np.rint((z - low[:, None]) / step[:, None]).astype(np.int64)
            error = np.linalg.norm(z - low[:, None] - step[:, None] * u, axis=1)
            planes = np.stack([_words(((u >> j) & 1).astype(np.uint8)) for j in range(QUERY_BITS)], axis=1)
            self.levels.append((planes, low, step, u.sum(axis=1), error))

    def intervals(self, some: slice, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of each query of ``some`` with each coded vector."""
        m, n = len(self.length[some]), len(codes.length)
        middle, half = np.zeros((m, n)), np.zeros((m, n))
        for level, (planes, low, step, total, error) in enumerate(self.levels):
            words = codes.words[:, level]
            ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
            hits = np.zeros((m, n), np.int32)
            for j in range(QUERY_BITS):
                for w in range(words.shape[1]):
                    hits += np.bitwise_count(planes[some, j, w][:, None] & words[None, :, w]).astype(np.int32) << j
            signed = 2 * (low[some, None] * ones + step[some, None] * hits)
            signed -= (low[some] * self.dim + step[some] * total[some])[:, None]
            signed *= codes.along[:, level] / np.sqrt(self.dim)
            middle += signed
            half += error[some, None] * codes.along[:, level]
        half += self.length[some, None] * (codes.residual + _SLACK * self.dim * codes.length)
        return middle - half, middle + half
