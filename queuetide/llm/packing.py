"""Packing token ids into sequences of a fixed size, as a cutting-stock problem.

Whole runs of ``size`` ids of a document are sequences of their own. What is left of each
document is an item of 1 to size - 1 ids, cut to a multiple of ``grain``. The histogram of
these lengths, size / grain numbers, is all that the driver sees. Column generation solves
the linear program over patterns (sets of lengths that fit one sequence): a knapsack
dynamic program prices new patterns from the duals, a revised simplex takes them in.
Pattern counts are rounded down and dealt to the items of each length in rank order,
arithmetically. The ends below ``grain`` and the few items that rounding leaves are laid
end to end and cut into sequences, the rest of the last one into powers of two, which
need no padding.

The grain keeps the program to 63 rows; with a row per length (grain 1) it takes hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MB, slices, written
from .tokens import encoder, tokenizer_path

SIZE, GRAIN = 1024, 16
PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def knapsack(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths (``values[l]`` for length l) within ``size``."""
    best, choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    upward = values[1:]
    for c in range(1, size + 1):
        worth = best[c - 1::-1] + upward[:c] if c > 1 else best[:1] + upward[:1]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], choice[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(size + 1, np.int64), size
    while c > 0:
        if choice[c]:
            counts[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[size]), counts


def cutting_stock(histogram: np.ndarray, size: int = SIZE, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, fractional; ``histogram[l]`` items have length l.

    Ends when no pattern prices out, or within ``gap`` of total length / size, which no
    packing can beat.
    """
    lengths = np.flatnonzero(histogram)
    m = len(lengths)
    if m == 0:
        return []
    demand = histogram[lengths].astype(float)
    bound = float((demand * lengths).sum()) / size
    patterns = []
    for i, l in enumerate(lengths):
        p = np.zeros(m)
        p[i] = size // l
        patterns.append(p)
    fill = size // lengths
    inverse = np.diag(1.0 / fill)
    x = demand / fill
    while x.sum() > bound * (1 + gap):
        duals = inverse.sum(axis=0)
        values = np.full(size + 1, -1.0)
        values[lengths] = np.maximum(duals, 0)
        worth, counts = knapsack(values, size)
        if worth <= 1 + 1e-9:
            break
        column = counts[lengths].astype(float)
        d = inverse @ column
        able = np.flatnonzero(d > 1e-9)
        ratio = x[able] / d[able]
        r = able[int(ratio.argmin())]
        step = x[r] / d[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        patterns[r] = column
    return [(np.repeat(lengths, p.astype(int)), float(v)) for p, v in zip(patterns, x)]


class Plan:
    """Where the item of a given length and rank goes; ``histogram[l]`` items have length l."""

    def __init__(self, histogram: np.ndarray, n_whole: int, size: int = SIZE, grain: int = GRAIN):
        self.size, self.grain, self.n_whole = size, grain, n_whole
        lengths = np.arange(size)
        units = lengths // grain
        demand = np.bincount(units, weights=histogram, minlength=size // grain).astype(np.int64)
        demand[0] = 0
        slots: dict[int, list[list[int]]] = {}
        used = np.zeros(len(demand), np.int64)
        sequence = n_whole
        for pattern, often in cutting_stock(demand, size // grain):
            kinds, copies = np.unique(pattern, return_counts=True)
            n = min([int(often + 1e-6), *((demand - used)[kinds] // copies)])
            if n <= 0:
                continue
            at = 0
            for u, c in zip(kinds.tolist()[::-1], copies.tolist()[::-1]):
                slots.setdefault(u, []).append([int(used[u]), c, sequence, at])
                used[u] += n * c
                at += c * u * grain
            sequence += int(n)
        self.tables = {u: np.array(rows, np.int64) for u, rows in slots.items()}
        self.first_loose = sequence
        # Items of one unit count rank by length, then by rank; the first ``used`` of them are placed.
        total_before = np.concatenate([[0], np.cumsum(histogram)])[:-1]
        self.rank_base = total_before - total_before[units * grain]
        self.placed = np.clip(used[units] - self.rank_base, 0, histogram)
        loose = self.placed * (lengths % grain) + (histogram - self.placed) * lengths
        self.loose_at = np.concatenate([[0], np.cumsum(loose)]).astype(np.int64)
        total = int(self.loose_at[-1])
        whole, rest = divmod(total, size)
        cuts = [whole * size]
        bit = size // 2
        while rest:
            if rest >= bit:
                cuts.append(cuts[-1] + bit)
                rest -= bit
            bit //= 2
        self.tail = np.array(cuts, np.int64)
        self.whole_loose = whole

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(ids of the item before the piece, its length, sequence, offset) of each piece."""
        pieces, done = [], 0
        placed, end = int(self.placed[length]), length % self.grain
        at = int(self.loose_at[length]) + min(rank, placed) * end + max(rank - placed, 0) * length
        if rank < placed:
            done = length - end
            unit = done // self.grain
            number, table = int(self.rank_base[length]) + rank, self.tables[unit]
            first, copies, sequence, offset = table[int(np.searchsorted(table[:, 0], number, side="right")) - 1].tolist()
            copy, slot = divmod(number - first, copies)
            pieces.append((0, done, sequence + copy, offset + slot * done))
        at -= done
        while done < length:
            here = at + done
            if here < self.tail[0]:
                k = here // self.size
                begin, stop = k * self.size, (k + 1) * self.size
            else:
                t = int(np.searchsorted(self.tail, here, side="right")) - 1
                k, begin, stop = self.whole_loose + t, int(self.tail[t]), int(self.tail[t + 1])
            n = min(length - done, stop - here)
            pieces.append((done, n, self.first_loose + k, here - begin))
            done += n
        return pieces


def pack_documents(docs: DataFrame, size: int = SIZE, grain: int = GRAIN, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids, with their sequence and offset there; every id is in one piece.

    Columns: doc_id, start (the document's ids before the piece), length, doc_tokens (with
    the end id), sequence_id, offset (gapless from 0 in a sequence), ids (binary,
    little-endian unsigned 32-bit). A null text is empty and has the end id alone; rows
    that share a doc_id, or have none, are documents of their own. Only doc_id and text
    are read; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, ids binary, n_tokens long, part int, whole_before long, rest int, rank long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(size, np.int64), 0
        for batch in slices(batches, size=8 * MB):
            ids, first = encoder(path).encode(batch.column("text"), end_id)
            n = np.diff(first)
            rest, wholes = n % size, n // size
            order = np.argsort(rest, kind="stable")
            by = rest[order]
            begin = np.searchsorted(by, by, side="left")
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - begin + seen[by]
            seen += np.bincount(rest, minlength=size)
            before = whole + np.cumsum(wholes) - wholes
            whole += int(wholes.sum())
            data = pa.py_buffer(ids.astype("<u4", copy=False))
            for a in range(0, len(n), 512):
                b = min(a + 512, len(n))
                offsets = ((first[a:b + 1] - first[a]) * 4).astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), b - a, [
                    None, pa.py_buffer(offsets), data.slice(int(first[a]) * 4, int(first[b] - first[a]) * 4)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), binary, pa.array(n[a:b]), pa.array([part] * (b - a), pa.int32()),
                     pa.array(before[a:b]), pa.array(rest[a:b].astype(np.int32)), pa.array(rank[a:b])],
                    names=["doc_id", "ids", "n_tokens", "part", "whole_before", "rest", "rank"])

    encoded = written(docs.select("doc_id", "text").mapInArrow(encode, schema), "encoded")

    # Ranks over all tasks: items of a length in earlier tasks, whole sequences of earlier tasks.
    counts = written(encoded.groupBy("part", "rest").agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / size)).alias("wholes")), "counts")
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = counts.groupBy("part").agg(F.sum("wholes").alias("wholes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    per_task = per_task.select("part", F.coalesce(F.sum("wholes").over(before), F.lit(0)).alias("whole_base"))
    histogram, n_whole = np.zeros(size, np.int64), 0
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("wholes").alias("wholes")).collect():  # at most ``size`` rows
        histogram[r["rest"]] = r["n"]
        n_whole += r["wholes"]
    histogram[0] = 0
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, n_whole, size, grain))

    # One row per task with the ranks that its items begin at; Spark broadcasts it as long as its size allows.
    begins = (counts.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
              .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "rank_base"))).alias("rank_bases")))
    begins = written(begins.join(per_task, "part"), "ranks")
    placed = encoded.join(begins, "part").select(
        "doc_id", "ids", "n_tokens", (F.col("whole_base") + F.col("whole_before")).alias("whole"), "rest",
        (F.col("rank_bases")[F.col("rest")] + F.col("rank")).alias("rank"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = plan.value.place
        for batch in slices(batches, "ids", 8 * MB):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "ids", "n_tokens", "whole", "rest", "rank")]
            out: list[tuple] = []
            for doc, ids, n, whole, rest, rank in zip(*columns):
                for k in range(n // size):
                    out.append((doc, k * size, size, n, whole + k, 0, ids[4 * k * size:4 * (k + 1) * size]))
                base = n - rest
                if rest:
                    for done, length, sequence, at in place(rest, rank):
                        begin = base + done
                        out.append((doc, begin, length, n, sequence, at, ids[4 * begin:4 * (begin + length)]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([o[i] for o in out], pa.int64()) for i in range(6)), pa.array([o[6] for o in out], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
