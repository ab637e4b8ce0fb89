"""Toxicity by weak supervision.

Voters look at a text: lexicons of word beginnings of several lengths, drawn from labelled
rows where they mark toxic texts beyond chance, and patterns (capitals, exclamation marks,
length). A generative label model learns from the counts of vote patterns over all texts
outside the held-out part how often each voter fires in either class, and which voters
depend on one another (a tree of the strongest conditional correlations). Its posteriors
label a bounded sample, on which a logistic regression is fitted that scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, slices, written
from .words import LOWER, Words, mix, split_words

STEMS = (4, 5, 6, 9, 200)  # bytes of a word's beginning; the last is the whole word
MIN_SUPPORT, MIN_Z, MIN_PRECISION = 8, 6.0, 0.5
# A stem counts from this share of the toxic texts on, too: a lexicon has at most as many entries as a
# toxic text has stems, over this share, however many texts there are.
LEAST_SHARE = 1e-5
SAMPLE = 40_000  # rows that the classifier is fitted on
THRESHOLD = 0.7
PATTERNS = ("any capitals run", "exclamation", "short text")
N_VOTERS = 2 * len(STEMS) + len(PATTERNS)


def stem_hashes(words: Words) -> list[np.ndarray]:
    """For each length, a hash of each word's beginning; 0 where the word is shorter (but for whole words)."""
    # Trailing ASCII punctuation is no part of a word.
    ends = words.ends.copy()
    for _ in range(3):
        last = words.data[np.maximum(ends - 1, 0)]
        ends = np.where((ends - 1 > words.starts) & (last < 128) & ~np.isin(last, _ALNUM), ends - 1, ends)
    out = []
    for k, length in enumerate(STEMS):
        stop = np.minimum(ends, words.starts + length)
        h = mix(words.span_hashes(stop), 60 + k)
        if k + 1 < len(STEMS):
            h = np.where(ends - words.starts >= length, h, np.uint64(0))
        out.append(h)
    return out


_ALNUM = np.array([b for b in range(128) if chr(b).isalnum()], np.uint8)


@dataclass
class Lexicon:
    hashes: list[np.ndarray]  # per stem length, sorted
    weights: list[np.ndarray]  # log odds


def _count_stems(batches):
    """Per stem: texts of either label that have it, summed over the task."""
    held = None
    for batch in slices(batches, size=8 * MB):
        words = split_words(batch.column("text"), lower=True)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(batch.num_rows), words.counts())
        parts = []
        for k, h in enumerate(stem_hashes(words)):
            keep = h != 0
            order = np.lexsort((h[keep], text[keep]))
            t, v = text[keep][order], h[keep][order]
            new = np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1]))[:len(v)]
            distinct, back = np.unique(v[new], return_inverse=True)
            label = toxic[t[new]]
            parts.append((np.full(len(distinct), k, np.int32), distinct, np.bincount(back, weights=label, minlength=len(distinct)),
                          np.bincount(back, weights=1 - label, minlength=len(distinct))))
        kind, value, ones, zeros = (np.concatenate(c) for c in zip(*parts))
        if held is not None:
            kind, value, ones, zeros = (np.concatenate(c) for c in zip(held, (kind, value, ones, zeros)))
            distinct, first, back = np.unique(value, return_index=True, return_inverse=True)  # kinds are hashed apart
            kind, value = kind[first], distinct
            ones, zeros = (np.bincount(back, weights=x, minlength=len(distinct)) for x in (ones, zeros))
        held = kind, value, ones, zeros
    if held is not None:
        for a in range(0, len(held[0]), 100_000):
            k, v, o, z = (x[a:a + 100_000] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v.view(np.int64)), pa.array(o.astype(np.int64)), pa.array(z.astype(np.int64))],
                                             names=["kind", "stem", "ones", "zeros"])


def fit_lexicon(labelled: DataFrame) -> Lexicon:
    """Stems that mark toxic texts beyond chance; ``labelled`` has text and toxic (0 or 1)."""
    totals = labelled.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    ones, n = float(totals["t"] or 0), float(totals["n"])
    empty = Lexicon([np.zeros(0, np.uint64) for _ in STEMS], [np.zeros(0) for _ in STEMS])
    if ones == 0 or ones == n:
        return empty
    base = ones / n
    counts = labelled.mapInArrow(_count_stems, "kind int, stem long, ones long, zeros long").groupBy("kind", "stem").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    total = F.col("ones") + F.col("zeros")
    precision = F.col("ones") / total
    z = (F.col("ones") - total * base) / F.sqrt(total * base * (1 - base))
    low = (precision + 1.92 / total - 1.96 * F.sqrt(precision * (1 - precision) / total + 0.96 / (total * total))) / (1 + 3.84 / total)
    odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("zeros") + 0.5) / (n - ones + 1))
    support = max(float(MIN_SUPPORT), ones * LEAST_SHARE)
    chosen = counts.where((F.col("ones") >= support) & (z >= MIN_Z) & (low >= MIN_PRECISION)).select("kind", "stem", odds.alias("w"))
    rows = chosen.toPandas()
    for k in range(len(STEMS)):
        own = rows[rows["kind"] == k].sort_values("stem")
        h = own["stem"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        empty.hashes[k], empty.weights[k] = h[order], own["w"].to_numpy()[order]
    return empty


def look(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text and the votes, as a bit pattern."""
    raw = split_words(column)
    n = len(column)
    counts = raw.counts()
    text = np.repeat(np.arange(n), counts)
    lowered = Words(LOWER[raw.data], raw.starts, raw.ends, raw.first)
    features, votes = [], []
    for k, h in enumerate(stem_hashes(lowered)):
        own, weights = lexicon.hashes[k], lexicon.weights[k]
        if len(own):
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            hit = own[at] == h
            w = np.where(hit, weights[at], 0.0)
        else:
            hit, w = np.zeros(len(h), bool), np.zeros(len(h))
        hits = np.bincount(text, weights=hit, minlength=n)
        features += [np.log1p(hits), np.minimum(np.bincount(text, weights=w, minlength=n), 20) / 10, hits / np.maximum(counts, 1)]
        votes += [hits >= 1, hits >= 2]
    size = np.maximum(raw.ends - raw.starts, 1)
    caps = np.zeros(len(size))
    if len(size):
        upper = np.append((raw.data >= ord("A")) & (raw.data <= ord("Z")), False).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(upper)])
        caps = ((sums[raw.ends] - sums[raw.starts]) == size) & (size >= 3)
        mark = np.concatenate([[0], np.cumsum(raw.data == ord("!"))])
        loud = (mark[raw.ends] - mark[raw.starts]) > 0
    else:
        loud = caps
    caps_n, loud_n = (np.bincount(text, weights=x, minlength=n) for x in (caps, loud))
    features += [caps_n / np.maximum(counts, 1), loud_n / np.maximum(counts, 1), (counts < 40).astype(float)]
    votes += [caps_n >= 2, loud_n >= 1, counts < 40]
    pattern = np.zeros(n, np.int64)
    for i, v in enumerate(votes):
        pattern |= v.astype(np.int64) << i
    return np.stack(features, axis=1), pattern


@dataclass
class LabelModel:
    """P(class) and P(vote | class, vote of the voter it depends on)."""

    prior: float
    parent: list[int]
    table: np.ndarray  # voter, class, parent's vote -> chance to fire

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(votes), 2)) + np.log([1 - self.prior, self.prior])
        for i, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                fire = self.table[i, y, above]
                logs[:, y] += np.log(np.where(votes[:, i] == 1, fire, 1 - fire))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def fit_label_model(votes: np.ndarray, free: np.ndarray, ones: np.ndarray, zeros: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over distinct vote patterns.

    ``free`` counts the texts of each pattern without a label, ``ones`` and ``zeros`` those
    with one. Each round fits the dependency tree (Chow-Liu, given the class) anew.
    """
    m = votes.shape[1]
    known = ones + zeros
    guess = np.where(known > 0, (ones + 0.1) / (known + 0.2), votes[:, :2 * len(STEMS)].mean(axis=1))
    model = LabelModel(0.5, [-1] * m, np.full((m, 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([zeros + free * (1 - guess), ones + free * guess], axis=1)
        total = weight.sum()
        information = np.zeros((m, m))
        joint = np.zeros((m, m, 2, 2, 2))
        for y in (0, 1):
            w = weight[:, y]
            on = votes.astype(float)
            both = (on * w[:, None]).T @ on
            single, mass = both.diagonal(), w.sum()
            cells = {(1, 1): both, (1, 0): single[:, None] - both, (0, 1): single[None, :] - both,
                     (0, 0): mass - single[:, None] - single[None, :] + both}
            for (a, b), c in cells.items():
                joint[:, :, y, a, b] = c
                pa_ = (single if a else mass - single)[:, None]
                pb = (single if b else mass - single)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    information += np.where(c > 0, c / total * np.log(c * mass / (pa_ * pb)), 0)
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            i, p = max(((i, p) for i in range(m) if i not in inside for p in inside), key=lambda e: information[e])
            parent[i] = p
            inside.add(i)
        table = np.zeros((m, 2, 2))
        for i, p in enumerate(parent):
            for y in (0, 1):
                for above in (0, 1):
                    if p >= 0:
                        fire, quiet = joint[i, p, y, 1, above], joint[i, p, y, 0, above]
                    else:
                        fire, quiet = joint[i, i, y, 1, 1], joint[i, i, y, 0, 0]
                    table[i, y, above] = (fire + 0.5) / (fire + quiet + 1)
        model = LabelModel(float(np.clip(weight[:, 1].sum() / max(total, 1), 1e-4, 1 - 1e-4)), parent, table)
        following = model.posterior(votes)
        if np.abs(following - guess).max() < 1e-4:
            break
        guess = following
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last: constant) of a logistic regression on labels between 0 and 1, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    scale = max(len(x), 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / scale + penalty * w / 10
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / scale + np.diag(penalty / 10)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        w -= step if size < 5 else step * (5 / size)
        if size < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        features, _ = look(column, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -500, 500)))


def default_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out=None) -> ToxicityModel:
    """Lexicons, label model and classifier from the rows that are not held out.

    Labels (doc_id, toxic) of held-out rows are not looked at (by default where
    crc32(doc_id) mod 3 is 1); a null label is none. Without labels of both kinds the
    lexicons are empty and scores follow the patterns alone. The classifier is fitted on
    ``SAMPLE`` rows at most, those with the smallest hashes of doc_id and features, half of
    them with a vote for toxic if there are as many.
    """
    held_out = held_out if held_out is not None else default_held_out()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out)
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    learn = learn.where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels grow with the texts, so the join is dealt by key at any size.
    lexicon = fit_lexicon(docs.join(learn.hint("merge"), "doc_id").select("text", "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in slices(batches):
            features, pattern = look(batch.column("text"), shared.value)
            offsets = np.arange(0, features.size + 1, features.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.ravel())), pa.array(pattern)],
                names=["doc_id", "features", "pattern"])

    seen = written(docs.mapInArrow(run, "doc_id long, features array<double>, pattern long"), "votes")
    # A row per distinct pattern of the votes: 2 ** N_VOTERS at most, in fact a few hundred.
    patterns = seen.join(learn, "doc_id", "left").groupBy("pattern").agg(
        F.count(F.when(F.col("toxic").isNull(), 1)).alias("free"), F.count(F.when(F.col("toxic") == 1, 1)).alias("ones"),
        F.count(F.when(F.col("toxic") == 0, 1)).alias("zeros")).orderBy("pattern").toPandas()
    votes = (patterns["pattern"].to_numpy(np.int64)[:, None] >> np.arange(N_VOTERS)) & 1
    weights = np.zeros(3 * len(STEMS) + len(PATTERNS) + 1)
    if len(patterns):
        model = fit_label_model(votes, *(patterns[c].to_numpy(float) for c in ("free", "ones", "zeros")))
        lexical = (1 << 2 * len(STEMS)) - 1
        voted = (patterns["pattern"].to_numpy(np.int64) & lexical) != 0
        sizes = patterns[["free", "ones", "zeros"]].sum(axis=1).to_numpy()
        some = F.col("pattern").bitwiseAND(F.lit(lexical)) != 0
        sample = _smallest_hashes(seen.where(some), int(sizes[voted].sum()), SAMPLE // 2).unionByName(
            _smallest_hashes(seen.where(~some), int(sizes[~voted].sum()), SAMPLE // 2)).select("features", "pattern").toPandas()
        drawn = (sample["pattern"].to_numpy(np.int64)[:, None] >> np.arange(N_VOTERS)) & 1
        weights = fit_logistic(np.stack(sample["features"].to_numpy()), model.posterior(drawn))
    return ToxicityModel(lexicon, weights)


def _smallest_hashes(seen: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` rows of about ``n`` with the smallest hashes; those far from it are not sorted, nor sent to the last task."""
    enough = most + 10 * most ** 0.5 + 100
    hashed = seen.withColumn("_hash", F.xxhash64("doc_id", "features"))
    if n > enough:
        hashed = hashed.where(F.col("_hash") < int(-2**63 + 2**64 * (enough / n)))
    return hashed.orderBy("_hash", "doc_id").limit(most).drop("_hash")


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= threshold) of each row.

    Null and empty texts have no hits and get the score of such a text. Rows that repeat a
    doc_id are scored each; only doc_id and text are read, and of labels doc_id and toxic.
    """
    held_out = held_out if held_out is not None else default_held_out()
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, held_out))

    def run(batches):
        for batch in slices(batches):
            score = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold.

    Null and empty texts score as such texts do, rows without a doc_id or with a repeated one
    by their text alone; an empty table stays empty. A score at the threshold goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
