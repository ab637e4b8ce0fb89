"""Whitening of embeddings by their principal components.

Entries become whole numbers, so their sums per dimension are exact. Tasks send the
sums of products of centred vectors, a matrix of the dimension each; what meets on the
driver is one matrix, whose components ``qdwh`` finds. Their projections, broadcast,
whiten every vector where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .qdwh import EPS, eigenpairs
from .vectors import usable_vectors

SCALE, ADD = 64.0, 1_000_000.0
AT_ONCE = 8192  # vectors
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _parts(batches: Iterator[pa.RecordBatch]):
    """(batch, rows with a usable vector, their whole-number matrix)."""
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(a, AT_ONCE)
            for at, x in usable_vectors(some.column("embedding"), SCALE, ADD):
                yield some, at, x


def _totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors of the commonest length (the longer of two) and the exact sum of each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for _, at, x in _parts(batches):
            total = seen.setdefault(x.shape[1], [0, 0])
            total[0] += len(at)
            total[1] = total[1] + x.astype(np.int64).astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else (
                total[1] + x.astype(np.int64).sum(axis=0).astype(object))
        for dim, (n, total) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                 pa.array([str(t) for t in total])], names=["dim", "i", "n", "total"])

    per_task = rows.mapInArrow(sums, "dim int, i int, n long, total string")
    totals = per_task.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    best = totals.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, np.zeros(0, object)
    found = sorted((r["i"], int(r["total"])) for r in totals.where(F.col("dim") == best["dim"]).collect())
    return best["n"], np.array([t for _, t in found], object)


class Centre:
    """Sums of all vectors, from which each is centred without rounding twice."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.most = max(abs(int(s)) for s in sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: 64 bits wide where they fit, else Python's own."""
        if self.n * int(np.abs(x).max(initial=0)) + self.most < 2**62:
            return self.n * x.astype(np.int64) - self.sums.astype(np.int64)
        return self.n * x.astype(np.int64).astype(object) - self.sums

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Sums over dimensions of squared deviations; null where beyond 64 bits."""
        if len(deviations) == 0:
            return []
        if deviations.dtype != object and self.dim * int(np.abs(deviations).max()) ** 2 < 2**62:
            return (deviations * deviations).sum(axis=1).tolist()
        return [s if s < 2**63 else None for s in (int(d) for d in (deviations.astype(object) ** 2).sum(axis=1))]


def _summed(rows: DataFrame, products, size: int) -> np.ndarray:
    """The sum over all tasks of a ``size`` by ``size`` matrix that ``products`` makes of one task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = products(batches)
        if total is not None:
            i, j = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
                                             names=["i", "j", "v"])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def whiten(rows: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    ``rows`` has vec_id and embedding; other columns are not read. Entries count as
    floor(64 * c) + 1000000. Rows whose vector is null, empty, or holds a null or
    non-finite entry are left out, and so are vectors of another length than the commonest
    (the longer one in a tie). Rows that repeat, share a vec_id or have none are rows of
    their own. Components without variance, to working precision, are left out; where all
    vectors are equal or there are none, no row is returned. ``deviation`` is null beyond 64 bits.
    """
    context = rows.sparkSession.sparkContext
    known = rows.select("vec_id", "embedding")
    n, sums = _totals(known)
    if n == 0:
        return rows.sparkSession.createDataFrame([], COLUMNS)
    dim = len(sums)
    centre = context.broadcast(Centre(n, sums))

    def covariance(batches):
        total = None
        for _, _, x in _parts(batches):
            if x.shape[1] == dim:
                d = centre.value.deviations(x).astype(np.float64) / n
                total = d.T @ d if total is None else total + d.T @ d
        return total

    v = _summed(known, covariance, dim) / n
    values, vectors = eigenpairs(v)
    values, vectors = values[:most], vectors[:, :most]
    real = values > dim * EPS * max(values[0], 0.0)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if k == 0:
        return rows.sparkSession.createDataFrame([], COLUMNS)
    project = context.broadcast(vectors / np.sqrt(values))

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        deviations = centre.value.deviations(x)
        return deviations, (deviations.astype(np.float64) / n) @ project.value

    def products(batches):
        """Sums of products of whitened vectors, bordered by their plain sums."""
        total = None
        for _, _, x in _parts(batches):
            if x.shape[1] == dim:
                z = np.hstack([whitened(x)[1], np.ones((len(x), 1))])
                total = z.T @ z if total is None else total + z.T @ z
        return total

    second = _summed(known, products, k + 1) / n
    off = second[:k, :k] - np.outer(second[:k, k], second[:k, k]) - np.eye(k)
    error = float(np.abs(off).max())
    explained = values / float(np.trace(v))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _parts(batches):
            if x.shape[1] != dim:
                continue
            deviations, z = whitened(x)
            m = len(at)
            ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
            squares = pa.array(centre.value.squares(deviations), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), squares,
                 pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[c.split()[0] for c in COLUMNS.split(", ")])

    return known.mapInArrow(apply, COLUMNS)
