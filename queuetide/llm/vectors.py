"""Vectors of Arrow batches as matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LARGEST = 2.0**52  # beyond it a double no longer holds every whole number; entries are held at it


def usable_vectors(column: pa.Array, scale: float, add: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows with a vector of finite entries, and floor(scale * entry) + add as doubles.

    Null and empty vectors, and those with a null or non-finite entry, are in none.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    begins, lengths = offsets[:-1], np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[offsets[1:]] == bad[begins]) & (lengths > 0)
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == length))
        matrix = values[begins[rows][:, None] + np.arange(length)]
        yield rows, np.clip(np.floor(scale * matrix) + add, -LARGEST, LARGEST)


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; beyond 64 bits held at the ends."""
    if len(left) == 0:
        return np.zeros(0, np.int64)
    most = np.abs(left).max() * np.abs(right).max() * left.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    if most < 2.0**62:
        return np.einsum("ij,ij->i", left.astype(np.int64), right.astype(np.int64))
    sums = (left.astype(np.int64).astype(object) * right.astype(np.int64).astype(object)).sum(axis=1)
    return np.array([min(max(s, -2**63), 2**63 - 1) for s in sums], np.int64)
