"""Document fingerprints by one-permutation MinHash.

Every five-word shingle of a text is hashed once. The hash's high bits choose one of
``bins`` bins, which keeps its smallest value; an empty bin borrows from a full one that
a hash of (bin, attempt) names, the same for all texts (optimal densification). Of each
bin the low ``bits`` bits are kept, and likeness takes out the chance agreement of
``2**-bits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MB, slices, written
from .words import mix, shingle_hashes, split_words

BINS, BITS, SHINGLE = 512, 4, 5
ATTEMPTS = 24
EMPTY = np.uint64(2**64 - 1)


def _densify(values: np.ndarray) -> np.ndarray:
    """Fill empty bins; rows without any full bin stay empty."""
    n, bins = values.shape
    full = values != EMPTY
    open_rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    if len(open_rows) == 0:
        return values
    source, missing = values[open_rows], ~full[open_rows]
    out = source.copy()
    at = np.arange(bins, dtype=np.uint64)
    for attempt in range(ATTEMPTS):
        donor = (mix(at, 100 + attempt) % np.uint64(bins)).astype(np.int64)
        take = missing & (source[:, donor] != EMPTY)
        out[take] = source[:, donor][take]
        missing &= ~take
    # What no attempt reached (very short texts) walks on from one more hashed bin to the next full one.
    rows, cols = np.nonzero(missing)
    if len(rows):
        begin = (mix(at, 99) % np.uint64(bins)).astype(np.int64)
        index = np.where(source != EMPTY, np.arange(bins), 4 * bins)
        doubled = np.concatenate([index, index + bins], axis=1)
        nearest = np.minimum.accumulate(doubled[:, ::-1], axis=1)[:, ::-1]
        out[rows, cols] = source[rows, nearest[rows, begin[cols]] % bins]
    values[open_rows] = out
    return values


def fingerprints(column: pa.Array, bins: int = BINS, bits: int = BITS, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each bin, one row per text, and which texts have words at all."""
    hashes, first = shingle_hashes(split_words(column), words, seed=11)
    n = len(first) - 1
    values = np.full(n * bins, EMPTY)
    owner = np.repeat(np.arange(n), np.diff(first))
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    slot = owner * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(values, slot, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    values = _densify(values.reshape(n, bins))
    return (values & np.uint64((1 << bits) - 1)).astype(np.uint8), np.diff(first) > 0


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Each row's low bits as lowercase hex; empty for a text without words."""
    flat = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(low), -1)
    whole = np.packbits(flat, axis=1)
    return [row.tobytes().hex() if s else "" for row, s in zip(whole, some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row; two empty texts are alike, one is like no other."""
    chance = 2.0 ** -bits
    estimate = ((a == b).mean(axis=1) - chance) / (1 - chance) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, np.clip(estimate, 0, 1), (some_a == some_b).astype(float))


def fingerprint_documents(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = SHINGLE) -> DataFrame:
    """doc_id and ``fingerprint`` (hex) of each row; null and wordless texts get the empty string.

    One row per input row; equal texts have equal fingerprints; other columns are not read.
    """

    def run(batches):
        for batch in slices(batches):
            low, some = fingerprints(batch.column("text"), bins, bits, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed(low, some, bits))],
                                             names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _compare(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following)]
    n = len(texts)
    low, some = fingerprints(pa.array(texts + edited + following[-1:], pa.large_string()))
    own, own_some, changed, changed_some = low[:n], some[:n], low[n:2 * n], some[n:2 * n]
    after, after_some = np.concatenate([own[1:], low[2 * n:]]), np.concatenate([own_some[1:], some[2 * n:]])
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
        pa.array(packed(own, own_some)), pa.array(packed(changed, changed_some)),
        pa.array(likeness(own, own_some, changed, changed_some)),
        pa.array(likeness(own, own_some, after, after_some))],
        names=[c.split()[0] for c in COMPARED.split(", ")])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, with their likeness and that to the next text.

    The edit swaps the second half for the beginning of the next document, in descending
    doc_id; the last document's next is the first. Nulls are empty texts and a null doc_id
    comes last; rows that share a doc_id follow the order of their texts' hashes. A single
    document is its own next.

    One range shuffle of the texts: a task compares neighbours as they stream by, and hands
    on its first and last row; those, one pair per task, are compared afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
             .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    schema = f"{COMPARED}, part int, edge string, text string"

    def row(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int32()), pa.array([""] * n), pa.nulls(n, pa.string())],
            names=[*batch.schema.names, "part", "edge", "text"])

    def edge(doc_id, text: str, part: int, kind: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_id], pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.string()) for _ in range(3)),
             *(pa.nulls(1, pa.float64()) for _ in range(2)), pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])],
            names=[*(c.split()[0] for c in COMPARED.split(", ")), "part", "edge", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in slices(batches, size=2 * MB):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if held is None:
                yield edge(ids[0], texts[0], part, "first")
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield row(_compare(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:]), part)
        if held is not None:
            yield edge(*held, part, "last")

    out = written(dealt.mapInArrow(run, schema), "fingerprints")
    edges = out.where("edge != ''").select("part", "edge", "doc_id", "text")
    firsts, lasts = edges.where("edge = 'first'"), edges.where("edge = 'last'")
    by_part = Window.orderBy("part")
    before = firsts.select(F.coalesce(F.lag("part").over(by_part), F.max("part").over(by_part.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"), F.col("text").alias("following"))
    joined = lasts.select("part", "doc_id", "text").join(before, "part")

    def close(batches):
        for batch in slices(batches, size=2 * MB):
            for i in range(batch.num_rows):
                yield _compare(batch.column("doc_id").slice(i, 1), [batch.column("text")[i].as_py()],
                               [batch.column("following")[i].as_py()])

    names = [c.split()[0] for c in COMPARED.split(", ")]
    return out.where("edge = ''").select(*names).unionByName(joined.mapInArrow(close, COMPARED))
