"""Hard negatives: rows of another label that score close below an anchor's positives.

Rows lie packed in blocks with their one-bit codes. Each block of anchors meets each
block of rows twice. First, intervals of the scores (see ``one_bit``) leave the rows of
the anchor's label that can be among its best; these are scored in whole numbers. With the
positives' scores known, the same is done for rows of other labels that can lie in the
window below one of them. Within a block a row is passed over only if enough others
surely come before it, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .one_bit import Codes, LEVELS, Queries, encode
from .vectors import exact_products, usable_vectors

ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 4096, 1024
SCALE = 256.0
AT_ONCE = 32  # anchors whose intervals are in memory at the same time
BLOCK = "dim int, n int, ids binary, labels binary, x binary, codes binary, along binary, lengths binary"
ANCHORS = "a_dim int, a_n int, a_ids binary, a_labels binary, a_x binary, scores binary"
NONE = np.iinfo(np.int64).min


def _blocks(rows_of: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (the last a matrix) put together or cut to ``size`` rows, for each width of the matrix."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for columns in rows_of:
        width = columns[-1].shape[1]
        held.setdefault(width, []).append(columns)
        if sum(len(c[0]) for c in held[width]) >= size:
            whole = [np.concatenate(c) for c in zip(*held[width])]
            full = len(whole[0]) // size * size
            for a in range(0, full, size):
                yield tuple(c[a:a + size] for c in whole)
            held[width] = [tuple(c[full:] for c in whole)]
    for parts in held.values():
        whole = [np.concatenate(c) for c in zip(*parts)]
        if len(whole[0]):
            yield tuple(whole)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0)
    return x.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    width = len(raw) // (n * dim)
    return np.frombuffer(raw, f"<i{width}").reshape(n, dim).astype(np.float64)


def pack_rows(rows: DataFrame) -> DataFrame:
    """Blocks of coded vectors from (vec_id, label, embedding)."""

    def usable(batches):
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for at, x in usable_vectors(batch.column("embedding"), SCALE):
                yield ids[at], labels[at], x

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x in _blocks(usable(batches), ROWS_PER_BLOCK):
            codes = encode(x)
            yield pa.RecordBatch.from_pylist([{
                "dim": x.shape[1], "n": len(ids), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(),
                "x": _narrow(x).tobytes(), "codes": codes.words.tobytes(), "along": codes.along.tobytes(),
                "lengths": np.stack([codes.residual, codes.length]).tobytes()}], schema=_schema(BLOCK))

    return rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(pack, BLOCK)


def pack_anchors(anchors: DataFrame) -> DataFrame:
    """Blocks from (anchor_id, label, embedding, scores: those of its positives, NONE where it has fewer)."""

    def usable(batches):
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label"))
            scores = batch.column("scores")
            scores = scores.flatten().to_numpy().reshape(len(ids), -1)
            for at, x in usable_vectors(batch.column("embedding"), SCALE):
                yield ids[at], labels[at], scores[at], x

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, scores, x in _blocks(usable(batches), ANCHORS_PER_BLOCK):
            yield pa.RecordBatch.from_pylist([{
                "a_dim": x.shape[1], "a_n": len(ids), "a_ids": ids.astype("<i8").tobytes(),
                "a_labels": labels.astype("<i8").tobytes(), "a_x": _narrow(x).tobytes(),
                "scores": scores.astype("<i8").tobytes()}], schema=_schema(ANCHORS))

    return anchors.select("anchor_id", "label", "embedding", "scores").mapInArrow(pack, ANCHORS)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])


class _Meeting:
    """A block of anchors and a block of rows."""

    def __init__(self, row: dict):
        dim, n, m = row["dim"], row["n"], row["a_n"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.anchor_ids, self.anchor_labels = (np.frombuffer(row[c], "<i8") for c in ("a_ids", "a_labels"))
        self.x, self.q = _matrix(row["x"], n, dim), _matrix(row["a_x"], m, dim)
        lengths = np.frombuffer(row["lengths"], "<f8").reshape(2, n)
        self.codes = Codes(np.frombuffer(row["codes"], "<u8").reshape(n, LEVELS, -1),
                           np.frombuffer(row["along"], "<f8").reshape(n, LEVELS), lengths[0], lengths[1])
        self.scores = np.frombuffer(row["scores"], "<i8").reshape(m, -1)
        self.queries = Queries(self.q)

    def chunks(self):
        """Anchors a few at a time with the ends of their intervals."""
        for a in range(0, len(self.anchor_ids), AT_ONCE):
            some = slice(a, a + AT_ONCE)
            yield a, some, *self.queries.intervals(some, self.codes)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [exact_products(self.q[i[a:a + 16384]], self.x[j[a:a + 16384]]) for a in range(0, len(i), 16384)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _kth(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest allowed value of each row, -inf where there are fewer."""
    masked = np.where(allowed, values, -np.inf)
    if masked.shape[1] < k:
        return np.full(len(masked), -np.inf)
    return np.partition(masked, -k, axis=1)[:, -k]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score.astype(np.float64), group)) if np.abs(score).max(initial=0) < 2**53 else np.array(
        sorted(range(len(group)), key=lambda p: (group[p], -int(score[p]), ids[p])), np.int64)
    by = group[order]
    return order[np.arange(len(by)) - np.searchsorted(by, by, side="left") < k]


def _positives(row: dict, k: int) -> tuple[np.ndarray, ...]:
    meet = _Meeting(row)
    found = []
    for a, some, low, high in meet.chunks():
        alike = (meet.anchor_labels[some, None] == meet.labels) & (meet.anchor_ids[some, None] != meet.ids)
        i, j = np.nonzero(alike & (high >= _kth(low, alike, k)[:, None]))
        score = meet.exact(a + i, j)
        best = _best(i, score, meet.ids[j], k)
        found.append((meet.anchor_ids[a + i[best]], meet.ids[j[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _negatives(row: dict, k: int, percent: int) -> tuple[np.ndarray, ...]:
    meet = _Meeting(row)
    found = []
    for a, some, low, high in meet.chunks():
        other = meet.anchor_labels[some, None] != meet.labels
        wanted = meet.scores[some]
        can = np.zeros(low.shape, bool)
        for p in range(wanted.shape[1]):
            top = wanted[:, p].astype(np.float64)[:, None]
            # Nothing lies between a part of a negative score and the score.
            top = np.where((wanted[:, p] == NONE)[:, None] | (top < 0), np.nan, top)
            least = top * (percent / 100)
            sure = other & (low >= least * (1 + 1e-15)) & (high <= top)
            enough = np.fmax(least * (1 - 1e-15), _kth(low, sure, k)[:, None])
            can |= other & (high >= enough) & (low <= top)
        i, j = np.nonzero(can)
        score = meet.exact(a + i, j)
        for p in range(wanted.shape[1]):
            top = wanted[i, p]
            within = np.flatnonzero((top != NONE) & _between(score, top, percent))
            best = within[_best(i[within], score[within], meet.ids[j[within]], k)]
            found.append((meet.anchor_ids[a + i[best]], np.full(len(best), p, np.int64), meet.ids[j[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _between(score: np.ndarray, top: np.ndarray, percent: int) -> np.ndarray:
    """percent * top <= 100 * score <= 100 * top, in whole numbers of any size."""
    if max(np.abs(score).max(initial=0), np.where(top == NONE, 0, np.abs(top)).max(initial=0)) < 2**55:
        return (percent * top <= 100 * score) & (score <= top)
    return np.array([percent * int(t) <= 100 * int(s) <= 100 * int(t) for s, t in zip(score, top)], bool)


def _met(anchors: DataFrame, rows: DataFrame, f, names: list[str]) -> DataFrame:
    """``f`` of every block of anchors with every block of rows; blocks of unlike dimension have nothing to say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["dim"] == row["a_dim"]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in f(row)], names=names)

    return rows.crossJoin(anchors).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _packed_anchors(anchors: DataFrame) -> DataFrame:
    n = anchors.count()
    return written(pack_anchors(anchors.repartition(max(1, -(-n // ANCHORS_PER_BLOCK)))), "anchor-blocks")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                        percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; other columns are not read. Components
    count as floor(256 * x); a score is their inner product, ties go to the smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of the same
    label; a positive's negatives the first ``negatives`` rows of another label with
    percent * positive_score <= 100 * negative_score <= 100 * positive_score.

    Rows without vec_id or label, and those whose vector is null, empty, or holds a null
    or non-finite entry, take no part; vectors of unlike length never meet. Rows that
    repeat a vec_id are candidates of their own, but never of an anchor of that vec_id,
    and of anchors that share one the row with the smallest label and vector stands. A
    pair whose window is empty gives no row, and so does an empty table. Scores beyond
    64 bits are held at their ends.
    """
    known = rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    blocks = written(pack_rows(known), "vector-blocks", **{"parquet.block.size": str(16 << 20)})
    whole = (F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    anchors = written(known.where(is_anchor & whole).groupBy(F.col("vec_id").alias("anchor_id")).agg(
        F.min(F.struct("label", "embedding")).alias("r")).select("anchor_id", "r.*"), "anchors")

    none = F.array(F.lit(NONE))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = _met(_packed_anchors(anchors.withColumn("scores", none)), blocks, lambda row: _positives(row, positives),
                 ["anchor_id", "vec_id", "score"])
    found = written(found.withColumn("p", F.row_number().over(first)).where(F.col("p") <= positives), "positives")

    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("p", "score"))).alias("s"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.get("s.score", p), F.lit(NONE)))
    scored = anchors.join(lists, "anchor_id").withColumn("scores", scores).drop("s")
    pairs = _met(_packed_anchors(scored), blocks, lambda row: _negatives(row, negatives, percent),
                 ["anchor_id", "p", "negative_id", "negative_score"])
    by_pair = Window.partitionBy("anchor_id", "p").orderBy(F.desc("negative_score"), "negative_id")
    pairs = pairs.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    named = found.select("anchor_id", (F.col("p") - 1).cast("long").alias("p"), F.col("vec_id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    return pairs.join(named, ["anchor_id", "p"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
