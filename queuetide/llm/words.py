"""Words of many texts at once, as positions and hashes in flat numpy arrays.

A word is a run of bytes outside space and 0x09-0x0D, so all work is done on UTF-8
bytes. One call handles the texts of one Arrow batch; memory is a constant multiple
of the batch's bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 20)
        ones = np.full(n, _BASE, np.uint64)
        ones[0] = 1
        _powers = np.multiply.accumulate(ones)
        ones[1:] = _BASE_INVERSE
        _inverses = np.multiply.accumulate(ones)


@dataclass
class Words:
    """``data[starts[i]:ends[i]]`` is word i; those of text d are ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.span_hashes(self.ends)

    def span_hashes(self, stops: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each word's start to its stop (not beyond its end).

        Differences of a running polynomial sum, a megabyte at a time.
        """
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            base = int(self.starts[a])
            b = max(int(np.searchsorted(self.ends, base + SEGMENT, side="right")), a + 1)
            n = int(self.ends[b - 1]) - base
            _grow(n + 1)
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.data[base:base + n]] * _powers[:n], out=sums[1:])
            at = self.starts[a:b] - base
            out[a:b] = (sums[stops[a:b] - base] - sums[at]) * _inverses[at]
            a = b
        return mix(out)

    def codes(self, needed: np.ndarray) -> np.ndarray:
        """A number for each word of the mask, equal exactly for equal words; others have 0."""
        out = np.zeros(len(self.starts), np.int32)
        at = np.flatnonzero(needed)
        if len(at):
            starts, lengths = self.starts[at], self.ends[at] - self.starts[at]
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.data[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])]
            array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
            out[at] = array.dictionary_encode().indices.to_numpy()
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def join(self, keep: np.ndarray, d: int) -> bytes:
        """The kept words of text d, joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        at = np.flatnonzero(keep[a:b]) + a
        if len(at) == 0:
            return b""
        starts, lengths = self.starts[at], self.ends[at] - self.starts[at] + 1
        out_at = np.cumsum(lengths) - lengths
        take = np.repeat(starts - out_at, lengths) + np.arange(lengths.sum())
        take[out_at[1:] - 1] = 0
        out = self.data[np.minimum(take, len(self.data) - 1)]
        out[out_at[1:] - 1] = 0x20
        return out[:-1].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    begins[edges] |= inside[edges]  # a text begins a new word even right behind another one
    begins[-1] = False
    starts = np.flatnonzero(begins)
    stops = ~inside
    stops[1:] &= inside[:-1]
    stops[0] = False
    text_ends = offsets[1:]
    text_ends = text_ends[text_ends > 0]
    stops[text_ends] |= inside[text_ends - 1]
    ends = np.flatnonzero(stops)
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first)


def shingle_hashes(words: Words, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the first of each text; a shorter text is one run.

    A text without words has none.
    """
    h = words.hashes()
    counts = words.counts()
    total = len(h)
    runs = np.zeros(total, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    width = np.zeros(total, np.int64)
    left = np.repeat(words.first[1:], counts) - np.arange(total)  # words from here to the text's end
    for k in range(n):
        ok = left > k
        idx = np.arange(total - k) if k else slice(None)
        shifted = np.zeros(total, np.uint64)
        shifted[:total - k] = h[k:]
        runs = np.where(ok, (runs * step) + shifted, runs)
        width += ok
        del idx
    keep = left >= n
    starts_of = words.first[:-1]
    short = (counts > 0) & (counts < n)
    keep[starts_of[short]] = True
    hashes = mix(runs[keep] + width[keep].astype(np.uint64), seed)
    per_text = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_text, out=first[1:])
    return hashes, first
