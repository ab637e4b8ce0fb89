"""Exact removal of repeated word windows, by super-k-mers.

A window is ``size`` consecutive words of one document. Its minimiser is the smallest hash
of the runs of ``part`` words in it. Consecutive windows with the same minimiser are a
super-k-mer: one string that travels to the minimiser's bucket. Equal windows have equal
minimisers, so each bucket can sort its windows on its own.

Before that, each task drops from every batch the windows that an earlier one of the batch
repeats: they are known to be copies, and a passage that a third of all documents share
reaches its bucket once per batch. Minimisers that remain frequent (common beginnings of
different windows) are dealt by a second minimiser, of other hashes, so that they do not
fill one bucket. Which are frequent is counted over all rows, in a table of fixed size.

Strings of one bucket travel compressed, in one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, grouped, slices
from .words import Words, mix, split_words

SIZE, PART = 20, 2
CELLS = 1 << 16  # minimisers are counted by the low bits of their hash


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width], by doubling; the last width - 1 entries cover what there is."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def _runs(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of h[i:i + n]; the last n - 1 entries are not whole."""
    out = h.copy()
    for k in range(1, n):
        out[:-k] = out[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:] if k < len(h) else out[:-k]
    return mix(out, seed)


class Windows:
    """The windows of a batch: where each starts, its minimisers and its words' exact codes."""

    def __init__(self, words: Words, size: int, part: int):
        self.words, self.size = words, size
        total, counts = len(words.starts), words.counts()
        text = np.repeat(np.arange(len(counts)), counts)
        self.at = np.flatnonzero(words.first[text + 1] - np.arange(total) >= size) if total else np.zeros(0, np.int64)
        self.text = text[self.at]
        h = words.hashes()
        self.low = [_window_min(_runs(h, part, seed), size - part + 1)[self.at] if total else np.zeros(0, np.uint64)
                    for seed in (3, 5)]
        self._words = h

    def hashes(self) -> np.ndarray:
        return _runs(self._words, self.size, 9)[self.at]


def _repeats(hashes: np.ndarray, at: np.ndarray, words: Words, size: int, order_by: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which windows have an equal one strictly before them in the order of ``order_by`` (last key first).

    Windows whose hash no other has are done. The rest is sorted by hash; neighbours are
    then compared word by word, so that a collision of hashes splits the group by its words.
    """
    several = np.flatnonzero(pd.Series(hashes).duplicated(keep=False).to_numpy())
    out = np.zeros(len(hashes), bool)
    if len(several):
        covered = np.zeros(len(words.starts) + 1, np.int32)
        covered[at[several]] += 1
        np.add.at(covered, at[several] + size, -1)
        codes = words.codes(np.cumsum(covered[:-1]) > 0)
        out[several] = _sorted_repeats(hashes[several], at[several], codes, size, tuple(k[several] for k in order_by))
    return out


def _sorted_repeats(hashes: np.ndarray, at: np.ndarray, codes: np.ndarray, size: int, order_by: tuple[np.ndarray, ...]) -> np.ndarray:
    order = np.lexsort((*order_by, hashes))
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    pairs = np.flatnonzero(same)
    if len(pairs) == 0:
        return out
    equal = np.ones(len(pairs), bool)
    left, right = at[order[pairs]], at[order[pairs + 1]]
    for k in range(size):
        equal &= codes[left + k] == codes[right + k]
    if not equal.all():  # different windows with one hash: settle those groups by their words
        joined = np.zeros(len(order), bool)
        joined[pairs + 1] = equal
        for value in np.unique(hashes[order[pairs[~equal] + 1]]).tolist():
            a, b = (int(np.searchsorted(hashes[order], value, side=side)) for side in ("left", "right"))
            by_words: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                by_words.setdefault(codes[at[i]:at[i] + size].tobytes(), []).append(i)
            order[a:b] = [i for group in by_words.values() for i in group]
            joined[a:b] = [k > 0 for group in by_words.values() for k in range(len(group))]
    else:
        joined = np.zeros(len(order), bool)
        joined[pairs + 1] = equal
    first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(order))))
    later = joined & np.logical_or.reduce([k[order] != k[order[first]] for k in order_by])
    out[order[later]] = True
    return out


def _distinct(batch: pa.RecordBatch, size: int, part: int) -> tuple[Windows, np.ndarray]:
    """The batch's windows, and which of them repeat an earlier one of the batch."""
    w = Windows(split_words(batch.column("text")), size, part)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    if len(w.at) == 0:
        return w, np.zeros(0, bool)
    return w, _repeats(w.hashes(), w.at, w.words, size, (w.at - w.words.first[w.text], ids[w.text]))


def _spans(text: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Window starts by text."""
    if len(text) == 0:
        return
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    for group in np.split(order, cuts):
        yield int(text[group[0]]), start[group]


def remove_repeats(docs: DataFrame, size: int = SIZE, part: int = PART, buckets: int | None = None) -> DataFrame:
    """Each text without the words of windows that also start earlier.

    Earlier: in a smaller doc_id, or in the same document before. Windows are judged on the
    input. Columns: doc_id, n_words, n_removed, text (kept words joined by one space).
    A null text has no words; rows without a doc_id keep all theirs and are no copies'
    source; rows that share a doc_id are read as versions of one document: equal starts are
    one place, none earlier, and what is a copy in one version goes from all of them. One row per input row; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    # In proportion to the input, as its splits are; a split holds several buckets' worth.
    buckets = buckets or 8 * max(known.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            low = Windows(split_words(batch.column("text")), size, part).low[0]
            if len(low):
                runs = low[np.concatenate([[True], low[1:] != low[:-1]])]
                cells += np.bincount((runs & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some])], names=["cell", "n"])

    counted = known.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    load = np.zeros(CELLS, np.int64)  # one number per cell, however large the input
    for r in counted:
        load[r["cell"]] = r["n"]
    hot = spark.sparkContext.broadcast(load > np.maximum(8 * load.mean(), 2000))

    schema = "bucket long, kind int, doc_id long, body binary"

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, size=8 * MB):
            w, again = _distinct(batch, size, part)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            # Known copies: their starts go straight to the document.
            where, bodies = [], []
            for text, starts in _spans(w.text[again], (w.at - w.words.first[w.text])[again]):
                where.append(ids[text])
                bodies.append(np.sort(starts).astype("<i4").tobytes())
            if where:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(where) % buckets, pa.int64()), pa.array([1] * len(where), pa.int32()), pa.array(where, pa.int64()),
                     pa.array(bodies, pa.binary())], names=["bucket", "kind", "doc_id", "body"])
            keep = ~again
            at, text = w.at[keep], w.text[keep]
            if len(at) == 0:
                continue
            key = w.low[0][keep]
            key = np.where(hot.value[(key & np.uint64(CELLS - 1)).astype(np.int64)], mix(key ^ w.low[1][keep], 21), mix(key, 20))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
            begin = np.flatnonzero(fresh)
            last = np.append(begin[1:], len(at)) - 1
            bucket = (key[begin] % np.uint64(buckets)).astype(np.int64)
            first_word, end_word = at[begin], at[last] + size
            lo, hi = w.words.starts[first_word], w.words.ends[end_word - 1]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            doc = ids[text[begin]].astype(np.int64)
            start = (first_word - w.words.first[text[begin]]).astype(np.int32)
            out = []
            for group in np.split(order, cuts):
                lengths = hi[group] - lo[group]
                begins = np.cumsum(lengths) - lengths
                strings = w.words.data[np.repeat(lo[group] - begins, lengths) + np.arange(lengths.sum())].tobytes()
                head = np.int64(len(group)).tobytes() + doc[group].tobytes() + start[group].tobytes() + lengths.astype(np.int32).tobytes()
                out.append((int(bucket[group[0]]), pack(head + strings)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.nulls(len(out), pa.int64()),
                 pa.array([x for _, x in out], pa.binary())], names=["bucket", "kind", "doc_id", "body"])

    def settle(table: pa.Table):
        known_copies = pc.equal(table.column("kind"), 1)
        yield from table.filter(known_copies).select(["doc_id", "body"]).to_batches()
        table = table.filter(pc.invert(known_copies))
        if table.num_rows == 0:
            return
        unpack = zstandard.ZstdDecompressor().decompress
        docs_, starts_, lengths_, strings_ = [], [], [], []
        for body in table.column("body").to_pylist():
            plain = unpack(body)
            n = int(np.frombuffer(plain, np.int64, 1)[0])
            docs_.append(np.frombuffer(plain, np.int64, n, 8))
            starts_.append(np.frombuffer(plain, np.int32, n, 8 + 8 * n))
            lengths_.append(np.frombuffer(plain, np.int32, n, 8 + 12 * n))
            strings_.append(np.frombuffer(plain, np.uint8, -1, 8 + 16 * n))
        doc, start = np.concatenate(docs_), np.concatenate(starts_).astype(np.int64)
        lengths = np.concatenate(lengths_).astype(np.int64)
        data = np.concatenate(strings_)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        column = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
        words = split_words(column)
        counts = words.counts()
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(words.first[text + 1] - np.arange(len(text)) >= size)
        place = start[text[at]] + at - words.first[text[at]]
        owner = doc[text[at]]
        again = _repeats(_runs(words.hashes(), size, 9)[at], at, words, size, (place, owner))
        ids, bodies = [], []
        for d, starts in _spans(owner[again], place[again]):
            ids.append(d)
            bodies.append(np.sort(starts).astype("<i4").tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    marks = grouped(known.mapInArrow(send, schema), ["bucket"], settle, "doc_id long, body binary").groupBy("doc_id").agg(F.collect_list("body").alias("marks"))
    joined = docs.join(marks, "doc_id", "left")

    def cut(batches):
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            counts = words.counts()
            removed = np.zeros(len(words.starts) + 1, np.int32)
            for d, bodies in enumerate(batch.column("marks").to_pylist()):
                for body in bodies or ():
                    starts = np.frombuffer(body, "<i4") + words.first[d]
                    np.add.at(removed, starts, 1)
                    np.add.at(removed, starts + size, -1)
            keep = np.cumsum(removed[:-1]) == 0
            gone = np.add.reduceat(np.append(~keep, False).astype(np.int64), words.first[:-1]) if len(counts) else counts
            gone = np.where(counts == 0, 0, gone)
            texts = [words.join(keep, d).decode("utf-8") for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(gone), pa.array(texts)],
                names=["doc_id", "n_words", "n_removed", "text"])

    return joined.select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def kept_digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
