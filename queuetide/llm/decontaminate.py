"""Benchmark items in texts, also when edited, by CGK embeddings and bit-sampling LSH.

Words are the symbols. An item of n words matches where some run of a text's words is at
most ``budget(n)`` word edits away. Cut into one segment more than edits, such a match
leaves a segment untouched, so every match is next to a place where three words of a
segment stand in order; only there are item-sized windows taken. A window and an item are
embedded by the same random walks (Chakraborty, Goldenberg, Koucky: each step writes the
current word and, by a hash of step and word, moves on or stays), which turns few edits
into a small Hamming distance. Sampled positions of a walk are a table's key; a window
meets the items of its size that share a key in one of ``WALKS * TABLES`` tables. What
meets is settled by the edit distance of the words themselves. Items of fewer than five
words allow no edit; those too short for a seed of three words are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .words import Words, mix, split_words

SHARE = 0.2  # edits allowed per word of an item
SEED = 3
WALKS, TABLES, SAMPLED = 8, 16, 3
BLOCK = 4096  # items searched in one pass over the texts
FILTER = 1 << 20


def budget(n: int, share: float = SHARE) -> int:
    """Word edits allowed for an item of n words: each segment must keep ``SEED`` words."""
    e = int(share * n)
    while e and n // (e + 1) < SEED:
        e -= 1
    return e


def embed(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, n: int, walk: int) -> np.ndarray:
    """Windows of n words from ``begin`` (not beyond ``stop``), two written words per word."""
    rows, steps = len(begin), 2 * n
    out = np.zeros((rows, steps), np.uint64)
    at, end = begin.copy(), np.minimum(begin + n, stop)
    last = len(words) - 1
    for j in range(steps):
        symbol = np.where(at < end, words[np.minimum(at, last)], np.uint64(0))
        out[:, j] = symbol
        at += (mix(symbol ^ np.uint64((j * 0x9E3779B97F4A7C15 + walk) & (2**64 - 1)), 70 + walk) & np.uint64(1)).astype(np.int64)
    return out


def table_keys(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """A key per window and table."""
    out = np.empty((len(begin), WALKS * TABLES), np.uint64)
    for walk in range(WALKS):
        written = embed(words, begin, stop, n, walk)
        for t in range(TABLES):
            draw = np.random.default_rng([n, walk, t])
            # The first steps only: near the end short windows have run out of words.
            places = draw.choice(max(int(1.5 * n), SAMPLED), SAMPLED, replace=False)
            key = np.full(len(begin), (walk * TABLES + t) << 8 | (n & 0xFF), np.uint64)
            for p in places:
                key = mix(key ^ written[:, min(p, 2 * n - 1)], 90)
            out[:, walk * TABLES + t] = key
    return out


def edit_match(item: list[bytes], region: list[bytes]) -> tuple[int, int, int]:
    """The fewest word edits between the item and a run of the region: (distance, start, end)."""
    codes: dict[bytes, int] = {}
    a = [codes.setdefault(w, len(codes)) for w in item]
    b = np.array([codes.setdefault(w, len(codes)) for w in region], np.int64)
    m = len(b)
    along = np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), along.copy()
    for i, symbol in enumerate(a, start=1):
        swap, drop = row[:-1] + (b != symbol), row[1:] + 1
        down = np.append(i, np.minimum(swap, drop))
        source = np.append(0, np.where(swap <= drop, origin[:-1], origin[1:]))
        level = down - along
        low = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low, along, 0))
        row, origin = low + along, source[at]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class Items:
    """One block of items: their words, seeds and table keys."""

    def __init__(self, ids: list[int], texts: list[str], share: float = SHARE):
        words = split_words(pa.array(texts, pa.large_string()), lower=True)
        hashes, counts = words.hashes(), words.counts()
        use = [i for i in range(len(ids)) if counts[i] >= SEED]
        short = [i for i in range(len(ids)) if 0 < counts[i] < SEED]
        place = {i: at for at, i in enumerate(short)}
        # By their length: hashes of the short items in order, and their numbers, which follow those of the others.
        self.short = {}
        for n in range(1, SEED):
            own = np.array([i for i in short if counts[i] == n], np.int64)
            if len(own):
                marks = _runs(hashes, n)[words.first[own]]
                order = np.argsort(marks, kind="stable")
                numbers = np.array([len(use) + place[i] for i in own.tolist()], np.int64)
                self.short[n] = (marks[order], numbers[order])
        self.short_words = [[words.word(k) for k in range(words.first[i], words.first[i + 1])] for i in short]
        self.ids = [ids[i] for i in [*use, *short]]
        self.words = [[words.word(k) for k in range(words.first[i], words.first[i + 1])] for i in use]
        self.edits = [budget(len(w), share) for w in self.words]
        seeds, owners, offsets = [], [], []
        for k, i in enumerate(use):
            n, e, first = len(self.words[k]), self.edits[k], int(words.first[i])
            for s in range(e + 1):
                o = s * n // (e + 1)
                seeds.append(_seed(hashes[first + o:first + o + SEED])[0])
                owners.append(k)
                offsets.append(o)
        order = np.argsort(np.array(seeds, np.uint64), kind="stable")
        self.seeds = np.array(seeds, np.uint64)[order]
        self.owner, self.offset = np.array(owners, np.int64)[order], np.array(offsets, np.int64)[order]
        self.maybe = np.zeros(FILTER, bool)
        self.maybe[(self.seeds & np.uint64(FILTER - 1)).astype(np.int64)] = True
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        keys, key_items = [], []
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            begin = np.array([words.first[use[k]] for k in own], np.int64)
            keys.append(table_keys(hashes, begin, begin + n, n).ravel())
            key_items.append(np.repeat(own, WALKS * TABLES))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.key_items = (np.concatenate(key_items) if key_items else np.zeros(0, np.int64))[order]


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each one on; the last ones of all have none and are left as 0."""
    out = np.zeros(len(h), np.uint64)
    whole = len(h) - n + 1
    if whole > 0:
        run = h[:whole].copy()
        for k in range(1, n):
            run = run * np.uint64(0xD6E8FEB86659FD93) + h[k:whole + k]
        out[:whole] = mix(run, 81)
    return out


def short_matches(words: Words, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (0, first word, end) of the first place of each short item in each text."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    h = words.hashes() if items.short else np.zeros(0, np.uint64)
    for n, (marks, numbers) in items.short.items():
        run = _runs(h, n)
        at = np.flatnonzero(np.isin(run, marks))
        low, high = (np.searchsorted(marks, run[at], side=s) for s in ("left", "right"))
        hit, which = _spread(low, high)
        place, number = at[which], numbers[hit]
        text = np.searchsorted(words.first, place, side="right") - 1
        inside = place + n <= words.first[text + 1]
        place, number, text = place[inside], number[inside], text[inside]
        pairs, first = np.unique(np.stack([text, number], axis=1), axis=0, return_index=True)
        for (t, k), begin in zip(pairs.tolist(), place[first].tolist()):
            if [words.word(i) for i in range(begin, begin + n)] == items.short_words[k - len(items.words)]:
                found[t, k] = (0, begin - int(words.first[t]), begin - int(words.first[t]) + n)
    return found


def _seed(h: np.ndarray) -> np.ndarray:
    out = h[:len(h) - SEED + 1].copy()
    for k in range(1, SEED):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k:len(h) - SEED + 1 + k]
    return mix(out, 80)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low to high, and the range each is of."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which], which


def candidate_windows(words: Words, items: Items) -> list[tuple[int, int, int]]:
    """(text, item, first word in the batch) of windows that meet an item in a table."""
    h = words.hashes()
    if len(h) < SEED or len(items.seeds) == 0:
        return []
    seed = _seed(h)
    at = np.flatnonzero(items.maybe[(seed & np.uint64(FILTER - 1)).astype(np.int64)])
    low, high = (np.searchsorted(items.seeds, seed[at], side=s) for s in ("left", "right"))
    which, hit = _spread(low, high)
    if len(which) == 0:
        return []
    at = at[hit]
    text = np.searchsorted(words.first, at, side="right") - 1
    inside = at + SEED <= words.first[text + 1]
    at, text, which = at[inside], text[inside], which[inside]
    size = items.sizes[items.owner[which]]
    begin = np.maximum(at - items.offset[which], words.first[text])
    windows = np.unique(np.stack([size, text, begin], axis=1), axis=0)
    out = []
    for n in np.unique(windows[:, 0]).tolist():
        own = windows[windows[:, 0] == n]
        keys = table_keys(h, own[:, 2], words.first[own[:, 1] + 1], n)
        low, high = (np.searchsorted(items.keys, keys.ravel(), side=s) for s in ("left", "right"))
        met, window = _spread(low, high)
        pairs = np.unique(np.stack([window // keys.shape[1], items.key_items[met]], axis=1), axis=0)
        out += [(int(own[w, 1]), int(k), int(own[w, 2])) for w, k in pairs.tolist() if items.sizes[k] == n]
    return out


def batch_matches(words: Words, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (distance, first word, end) of each item's best match in each text; the earliest of equals."""
    found = short_matches(words, items)
    for text, k, begin in sorted(candidate_windows(words, items)):
        e, n = items.edits[k], len(items.words[k])
        best = found.get((text, k))
        if best and (best[0] == 0 or best[1] + words.first[text] <= begin <= best[1] + words.first[text] + e):
            continue
        a = max(int(words.first[text]), begin - e)
        b = min(int(words.first[text + 1]), begin + n + e)
        distance, start, end = edit_match(items.words[k], [words.word(i) for i in range(a, b)])
        if distance <= e:
            first = a - int(words.first[text])
            match = (distance, first + start, first + end)
            if best is None or match < best:
                found[text, k] = match
    return found


def item_blocks(benchmark: DataFrame, share: float = SHARE) -> Iterator[Items]:
    """The items (null ids or texts aside) in blocks of ``BLOCK``."""
    ids, texts = [], []
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == BLOCK:
            yield Items(ids, texts, share)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts, share)


HITS = "doc_id long, item_id long, distance int, start_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per text and item that it holds: doc_id, item_id, distance, start_word, end_word.

    Words are runs outside white space, A-Z lower-cased; the span is the best match, the
    earliest of equals, end exclusive. Items of fewer than five words match where their
    words stand in order, items without words nowhere. Null texts hold nothing; rows without a doc_id are
    reported with a null one; repeated rows are reported each. The texts are read once per
    ``BLOCK`` items.
    """
    out = None
    for items in item_blocks(benchmark, share):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in slices(batches):
                found = batch_matches(split_words(batch.column("text"), lower=True), items)
                if found:
                    ids = batch.column("doc_id").to_pylist()
                    rows = [(ids[t], items.ids[k], *m) for (t, k), m in sorted(found.items())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
                         pa.array([r[4] for r in rows], pa.int64())], names=[c.split()[0] for c in HITS.split(", ")])

        hits = docs.select("doc_id", "text").mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows, with all their columns, whose text holds no item.

    Rows without a text stay; rows are judged one by one, whatever their doc_id. An empty
    table stays empty, and an empty benchmark, or one of null ids or texts, drops nothing.
    """
    for items in item_blocks(benchmark, share):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, _ in batch_matches(split_words(batch.column("text"), lower=True), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
