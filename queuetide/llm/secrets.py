"""Secrets in texts: fixed patterns, and strings that pass for random.

A candidate is a run of at least ``SHORTEST`` characters of the base64 alphabets, cut
where one character repeats ``SAME`` times or more. The narrowest alphabet that holds it is
its encoding (decimal, hex, base32, base62, base64). A battery measures how far all of it is
from a random string over that alphabet: chi-squared of the symbol counts, the number of
runs above and below the alphabet's middle, and the serial correlation of neighbours. Three
z-scores give one misfit; above ``GATE``, which one random string in two hundred passes, it
is not random.

Its p-value is the chance that ordinary text of the same length stays within the encoding
and is as even: the share of the encoding's characters among the corpus' letters, how often
one follows another, and the distribution of the chi-squared statistic of that many letters
as frequent as the corpus has them. All texts' letters are counted; a fixed profile of
``PRIOR`` letters is added, so that a small table has a null, too. Within each encoding and
length class the Benjamini-Hochberg procedure over all candidates of the corpus that no
pattern covers keeps the expected share of false finds below ``FDR``.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .words import text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
SHORTEST, SAME, FDR, GATE, PRIOR = 20, 8, 0.01, 2.1, 20_000
REPEATED = re.compile(r"(.)\1{%d,}" % (SAME - 1))
LENGTHS = np.array([20, 24, 28, 32, 40, 48, 64, 96])  # class k: from LENGTHS[k] to the next
ENCODINGS = ("decimal", "hex", "base32", "base62", "base64")
SIZES = np.array([10, 16, 32, 62, 64])
BINS, WIDTH = 1200, 0.05  # of the negative decimal logarithm of p
# How often the letters a to z are in a thousand letters of English.
FREQUENT = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]

_CLASS = np.zeros((5, 256), bool)
_CLASS[0, [*b"0123456789"]] = True
_CLASS[1, [*b"0123456789abcdefABCDEF"]] = True
_CLASS[2, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]] = True
_CLASS[3, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] = True
_CLASS[4, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="]] = True
_VALUE = np.zeros((5, 256), np.int64)
for _i, _letters in enumerate((b"0123456789", b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                               b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                               b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")):
    _VALUE[_i, [*_letters]] = np.arange(len(_letters))
_VALUE[1, [*b"ABCDEF"]] = np.arange(10, 16)
_VALUE[4, [*b"-_="]] = [62, 63, 0]


def encoding_of(token: bytes) -> int:
    """The narrowest alphabet that holds all of the token."""
    present = np.zeros(256, bool)
    present[np.frombuffer(token, np.uint8)] = True
    return int(np.argmax(~(present & ~_CLASS).any(axis=1)))


MOST = 1 << 20  # symbols at once


def misfits(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared symbol counts, and how unlike random strings over ``size`` symbols the
    rows are: the battery's three tests as one number."""
    rows, n = symbols.shape
    counts = np.bincount((symbols + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    squares = (counts.astype(float) ** 2).sum(axis=1)
    chi = squares * size / n - n
    # Mean size - 1, variance 2 (size - 1) (1 - 1/n) under uniformity, also where counts are small.
    z_chi = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (1 - 1 / n))
    above = symbols >= size // 2
    n1 = above.sum(axis=1)
    n0 = n - n1
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    mean = 2.0 * n0 * n1 / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    z_runs = np.where((n0 > 0) & (n1 > 0), (runs - mean) / spread, n)
    centred = symbols - symbols.mean(axis=1, keepdims=True)
    power = (centred ** 2).sum(axis=1)
    serial = np.where(power > 0, (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9), 1.0)
    z_serial = (serial + 1 / n) * np.sqrt(n)
    return squares, np.sqrt((z_chi ** 2 + z_runs ** 2 + z_serial ** 2) / 3)


def battery(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encoding, length, sum of squared symbol counts, and misfit of each whole token."""
    encoding = np.array([encoding_of(t) for t in tokens], np.int64)
    length = np.array([len(t) for t in tokens], np.int64)
    squares, misfit = np.zeros(len(tokens)), np.zeros(len(tokens))
    for e, n in set(zip(encoding.tolist(), length.tolist())):
        own = np.flatnonzero((encoding == e) & (length == n))
        some = max(1, MOST // n)
        for a in range(0, len(own), some):
            at = own[a:a + some]
            symbols = _VALUE[e][np.frombuffer(b"".join(tokens[i] for i in at), np.uint8).reshape(len(at), n)]
            squares[at], misfit[at] = misfits(symbols, int(SIZES[e]))
    return encoding, length, squares, misfit


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, bytes]]:
    """Runs of the base64 alphabets that are not letters of one case only (a first capital aside), without long repeats."""
    out = []
    for m in CANDIDATE.finditer(text):
        token, begin = m.group(), 0
        edges = [(r.start(), r.end()) for r in REPEATED.finditer(token)]
        for stop, following in [*edges, (len(token), 0)]:
            part = token[begin:stop]
            if len(part) >= SHORTEST and not (part[1:].islower() and part.isalpha()):
                out.append((m.start() + begin, m.start() + stop, part.encode("ascii")))
            begin = following
    return out


def uncovered(text: str, base: list | None = None) -> list[tuple[int, int, bytes]]:
    """The candidates that no fixed pattern touches."""
    found = candidates(text)
    if found and base is None:
        base = base_matches(text)
    return [c for c in found if not any(s < c[1] and c[0] < e for s, _, e, _ in base)]


class Ordinary:
    """Letters of the corpus: how many of each, and how often one of an encoding follows another."""

    def __init__(self):
        self.letters = np.zeros(256, np.int64)
        self.pairs = np.zeros(len(SIZES), np.int64)

    def add(self, data: np.ndarray) -> None:
        data = data[_CLASS[4][data]]
        self.letters += np.bincount(data, minlength=256)
        for e in range(len(SIZES)):
            inside = _CLASS[e][data]
            self.pairs[e] += np.count_nonzero(inside[1:] & inside[:-1])

    def with_prior(self) -> Ordinary:
        """The fixed profile: English letters, one in 30 a capital, one in 50 characters a digit, one in 100 a mark."""
        out = Ordinary()
        share = np.zeros(256)
        small = np.array(FREQUENT) / sum(FREQUENT)
        share[ord("a"):ord("z") + 1], share[ord("A"):ord("Z") + 1] = small * 29 / 30 * 0.97, small / 30 * 0.97
        share[ord("0"):ord("9") + 1] = 0.02 / 10
        share[[*b"+/-_="]] = 0.01 / 5
        out.letters = self.letters + np.rint(share * PRIOR).astype(np.int64)
        held = np.array([share[c].sum() for c in _CLASS])
        # Half of the digits have a digit behind them; letters follow one another by chance.
        out.pairs = self.pairs + np.rint(PRIOR * held * np.maximum(held, [0.5, 0, 0, 0, 0])).astype(np.int64)
        return out


class Null:
    """p-values under ordinary text."""

    def __init__(self, ordinary: Ordinary):
        seen = ordinary.with_prior()
        total = seen.letters.sum()
        self.terms = []
        for e, size in enumerate(SIZES.tolist()):
            counts = np.zeros(size)
            np.add.at(counts, _VALUE[e][_CLASS[e]], seen.letters[_CLASS[e]])
            share = counts / counts.sum()
            self.terms.append((size, counts.sum() / total, min(1.0, seen.pairs[e] / counts.sum()),
                               (share ** 2).sum(), (share ** 3).sum()))

    def minus_log(self, encoding: np.ndarray, length: np.ndarray, squares: np.ndarray, misfit: np.ndarray) -> np.ndarray:
        """-log10 of each p-value; 0 for what the battery takes for not random."""
        out = np.zeros(len(encoding))
        for i, (e, n, u) in enumerate(zip(encoding.tolist(), length.tolist(), squares.tolist())):
            if misfit[i] > GATE:
                continue
            _, share, stays, s2, s3 = self.terms[e]
            # Equal pairs among n letters: mean and variance when letters are drawn with these shares.
            mean = n * (n - 1) / 2 * s2
            spread = math.sqrt(n * (n - 1) / 2 * s2 * (1 - s2) + n * (n - 1.0) * (n - 2) * max(s3 - s2 * s2, 0.0))
            z = ((u - n) / 2 - mean) / max(spread, 1e-9)
            out[i] = -(math.log10(share) + (n - 1) * math.log10(stays) + _log_below(z))
        return np.maximum(out, 0)


def _log_below(z: float) -> float:
    """log10 of the chance that a standard normal number is at most ``z``."""
    if z > -30:
        return math.log10(0.5 * math.erfc(-z / math.sqrt(2)))
    return (-z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))) / math.log(10)


def cells(encoding: np.ndarray, length: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Class and bin of candidates as one number; bins are of rising p."""
    k = np.searchsorted(LENGTHS, length, side="right") - 1
    return (encoding * len(LENGTHS) + k) * BINS + BINS - 1 - np.minimum((strength / WIDTH).astype(np.int64), BINS - 1)


def limits(found: np.ndarray, fdr: float = FDR) -> np.ndarray:
    """Of each encoding and length class the first bin that no longer counts: Benjamini-Hochberg over its candidates."""
    out = np.zeros(found.shape[0], np.int64)
    p = 10.0 ** -(WIDTH * np.arange(BINS - 1, -1, -1))  # a bin's largest
    for c, counts in enumerate(found):
        ok = np.flatnonzero((p * counts.sum() <= fdr * np.cumsum(counts)) & (counts > 0))
        if len(ok):
            out[c] = ok[-1] + 1
    return out


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    spans lists ``kind:start:end`` of the patterns and of random strings that no pattern
    covers, by start, then kind; base_sha256 is the hash of the patterns' list. Positions
    are code points, ends exclusive. A null text is empty: no spans, the hash of nothing.
    One row per input row; only doc_id and text are read.

    Rows that repeat, share a doc_id or have none are each marked on their own.

    Two passes over the texts: letters and the candidates' statistics, then the marking.
    The driver sees letter counts and a histogram of p-values by class, both of fixed size.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches):
        letters = Ordinary()
        names = ["what", "n", "value", "misfit"]
        for batch in slices(batches, size=1 << 20):
            tokens = [t for text in batch.column("text").to_pylist() for _, _, t in uncovered(text)]
            letters.add(text_bytes(batch.column("text"))[0])
            if tokens:
                e, n, squares, misfit = battery(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(e.astype(np.int32)), pa.array(n), pa.array(squares), pa.array(misfit)], names=names)
        # Counts have numbers below zero: the letters, then the pairs.
        counts = np.concatenate([letters.letters, letters.pairs])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - some).astype(np.int32)), pa.array(counts[some]),
                                          pa.array(np.zeros(len(some))), pa.array(np.zeros(len(some)))], names=names)

    measured = written(docs.mapInArrow(measure, "what int, n long, value double, misfit double"), "battery")
    letters = Ordinary()
    for r in measured.where("what < 0").groupBy("what").agg(F.sum("n").alias("n")).collect():  # one per letter and encoding
        place = -1 - r["what"]
        if place < 256:
            letters.letters[place] = r["n"]
        else:
            letters.pairs[place - 256] = r["n"]
    null = docs.sparkSession.sparkContext.broadcast(Null(letters))

    def placed(batches):
        for batch in batches:
            e, n, squares, misfit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = cells(e.astype(np.int64), n, null.value.minus_log(e, n, squares, misfit))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["cell"])

    found = np.zeros(len(SIZES) * len(LENGTHS) * BINS, np.int64)
    for r in measured.where("what >= 0").mapInArrow(placed, "cell long").groupBy("cell").count().collect():  # one per class and bin
        found[r["cell"]] = r["count"]
    limit = docs.sparkSession.sparkContext.broadcast(limits(found.reshape(-1, BINS), fdr))

    def mark(batches):
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            base = [base_matches(t) for t in texts]
            owners, loose = [], []
            for i, text in enumerate(texts):
                for a, b, token in uncovered(text, base[i]):
                    owners.append((i, a, b))
                    loose.append(token)
            spans = [[(s, k, e) for s, k, e, _ in b] for b in base]
            if loose:
                encoding, length, squares, misfit = battery(loose)
                at = cells(encoding, length, null.value.minus_log(encoding, length, squares, misfit))
                for (i, a, b), ok in zip(owners, at % BINS < limit.value[at // BINS]):
                    if ok:
                        spans[i].append((a, 3, b))
            write = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
            kinds = np.array([[sum(k == kind for _, k, _, _ in b) for kind in range(3)] for b in base], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(kinds[:, k]) for k in range(3)),
                 pa.array([hashlib.sha256(write([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]),
                 pa.array([write(s) for s in spans])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.mapInArrow(mark, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
