"""Token counts, hard negatives and whitening against brute force, with every awkward case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuetide.llm import token_counts
from queuetide.llm.common import fresh_path
from queuetide.llm.negatives import mine_hard_negatives
from queuetide.llm.one_bit import Queries, encode
from queuetide.llm.qdwh import eigenpairs
from queuetide.llm.tokens import tokenizer_path
from queuetide.llm.whitening import whiten

SPECIAL = ["<|startoftext|>", "a<|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "Don't  'S 're", "Ａ ﬁ ſ É é", "x y z",
           "a\x1cb\x85c", "日本 語　x", "emoji 😀 !", "12 345", "́ a", "İstanbul ΟΔΟΣ", "A" * 5000, "Word", "word ", " WORD\n", "\tword"]
VECTORS = "vec_id long, label int, embedding array<float>"


def library(texts, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_equal_the_library(spark, docs, clashing, prose):
    texts = prose + SPECIAL
    frame = clashing(docs(texts)).withColumns({"digest": F.lit(1), "h": F.lit(2), "version": F.lit(3)})
    got = token_counts.count_tokens(frame, fresh_path(spark, "cache")).collect()
    want = library(texts)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == [
        (i, len((t or "").encode()), want[i]) for i, t in enumerate(texts)]


def test_only_distinct_misses_are_encoded_and_kept(spark, docs):
    cache = fresh_path(spark, "cache")
    version = token_counts.tokenizer_version(tokenizer_path("word_bpe_49k.json"))
    token_counts.count_tokens(docs(["one two", "ONE  two", "three", None, ""]), cache)
    assert token_counts.read_cache(spark, cache, version).count() == 3
    again = token_counts.count_tokens(docs(["three", "four", "One Two", "four"]), cache).collect()
    assert sorted(r["n_tokens"] for r in again) == sorted(library(["three", "four", "one two", "four"]))
    kept = token_counts.read_cache(spark, cache, version)
    assert kept.count() == kept.distinct().count() == 4


def test_a_stored_count_is_believed_and_another_version_is_not(spark, docs):
    cache = fresh_path(spark, "cache")
    path = tokenizer_path("word_bpe_49k.json")
    digest = token_counts.counter(path).digest("one two")
    rows = [(bytearray(digest), 77, token_counts.tokenizer_version(path)), (bytearray(digest), 99, "other")]
    spark.createDataFrame(rows, token_counts.CACHE).write.partitionBy("version").parquet(cache)
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs(["One  two"]), cache).collect()] == [77]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, docs, prose, name):
    texts = prose[:20] + SPECIAL
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(
        docs(texts), fresh_path(spark, "cache"), tokenizer_path(name)).collect()}
    if name.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        want = [len(s.encode(t or "")) for t in texts]
    else:
        want = library(texts, name)
    assert [got[i] for i in range(len(texts))] == want


def test_count_edges(spark, docs):
    empty = token_counts.count_tokens(docs([]), fresh_path(spark, "cache"))
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens"] and empty.count() == 0
    twice = docs(["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    both = twice.unionByName(docs(["c d e"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(["x"] * 2).withColumn("doc_id", F.lit(4)))
    got = token_counts.count_tokens(both, fresh_path(spark, "cache")).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2, 3]
    long = docs(["w " * 2_000_000 + "end"])  # more than a slice
    assert token_counts.count_tokens(long, fresh_path(spark, "cache")).first()["n_tokens"] == 2_000_001


# --- hard negatives ---------------------------------------------------------------

def brute_negatives(rows, is_anchor, positives=5, negatives=5, percent=80):
    usable = [(i, l, [math.floor(256 * float(np.float32(x))) for x in e]) for i, l, e in rows
              if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, l, e in usable:
        if is_anchor(i):
            raw = min((l2, [float(np.float32(x)) for x in e2]) for i2, l2, e2 in rows
                      if i2 == i and l2 is not None and e2 and all(x is not None and math.isfinite(x) for x in e2))
            anchors[i] = (raw[0], [math.floor(256 * x) for x in raw[1]])
    out = []
    for a, (label, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in usable if i != a and len(v) == len(q)]
        best = sorted((s, i) for s, i, l in scored if l == label)[:positives]
        for s, p in best:
            window = sorted((t, i) for t, i, l in scored if l != label and percent * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("clash"), "dim": F.lit(1), "anchor_id": F.lit(2)})
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_hard_negatives_equal_a_scan(spark, dim):
    draw = np.random.default_rng(dim)
    centres = draw.standard_normal((4, dim))
    rows = []
    for i in range(400):
        v = centres[draw.integers(4)] + 0.8 * draw.standard_normal(dim)
        rows.append((i, int(draw.integers(3)), (v / np.linalg.norm(v)).tolist()))
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_with_ties_nulls_and_copies(spark):
    draw = np.random.default_rng(1)
    rows = [(i, i % 3, draw.standard_normal(8).tolist()) for i in range(100)]
    same = draw.standard_normal(8).tolist()
    rows += [(1000 + i, i % 2, same) for i in range(90)]
    rows += [(2000, None, same), (2010, 1, None), (2020, 1, []), (2030, 1, [1.0, None] * 4), (2040, 0, [float("nan")] * 8),
             (2050, 0, [float("inf")] * 8), (None, 1, same), (2060, 1, [0.0] * 8), (2061, 1, [0.0] * 8), (2062, 0, [0.0] * 8),
             (2070, 1, [0.5, 0.25]), (2071, 1, [0.5, 0.5]), (2072, 2, [0.5, 0.25]), (-10, 0, same), (3, 0, same), (3, 0, same)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=2, negatives=3, percent=95) == brute_negatives(
        rows, lambda i: i % 10 == 0, 2, 3, 95)


def test_hard_negatives_of_long_vectors_and_of_none(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), -3e4 * i, 7.0]) for i in range(30)]  # products beyond 53 bits
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1.0])]) == []


def test_intervals_hold_the_product():
    draw = np.random.default_rng(3)
    for dim in (1, 5, 64, 130):
        x, q = draw.standard_normal((200, dim)) * 100, draw.standard_normal((40, dim)) * 100
        x[:3] = 0
        q[:2] = 0
        low, high = Queries(q).intervals(slice(0, 40), encode(x))
        exact = q @ x.T
        assert (low <= exact + 1e-9).all() and (exact <= high + 1e-9).all()
    assert (high - low).mean() < 0.3 * np.linalg.norm(q, axis=1).mean() * np.linalg.norm(x, axis=1).mean()


# --- whitening ---------------------------------------------------------------------

@pytest.mark.parametrize("values", [[5.0, 3.0, 2.0, 1.0], [4.0, 4.0, 4.0, 1.0, 1.0], [1.0], [7.0, 0.0, 0.0], [1e8, 1.0, 1e-4, 1e-4],
                                    list(range(1, 65)), [2.0] * 20])
def test_eigenpairs(values):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    v = q @ np.diag(values) @ q.T
    got, basis = eigenpairs(v)
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-13 * max(values) * n)
    assert np.abs(basis.T @ basis - np.eye(n)).max() < 1e-13
    assert np.abs(v @ basis - basis * got).max() < 1e-13 * max(values) * n


def whitened(spark, rows, schema=VECTORS, **options):
    df = spark.createDataFrame(rows, schema).withColumns({"n": F.lit("clash"), "component": F.lit(1), "i": F.lit(2)})
    return whiten(df, **options).collect()


def test_whitening_equals_dense_linear_algebra(spark):
    draw = np.random.default_rng(5)
    plain = (draw.standard_normal((300, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    rows = [(i, 0, e.tolist()) for i, e in enumerate(plain)]
    rows += [(500, 1, None), (501, 1, []), (502, 1, [None] * 40), (503, 1, [float("nan")] * 40), (504, 1, [1.0, 2.0]), (7, 0, rows[7][2]),
             (None, None, rows[8][2])]
    got = whitened(spark, rows)
    x = np.floor(64 * np.vstack([plain, plain[7:8], plain[8:9]]).astype(np.float64)).astype(np.int64) + 1000000
    n, total = len(x), x.sum(axis=0)
    d = (n * x - total).astype(float) / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = d @ vectors / np.sqrt(values)
    keys = [*range(300), 7, None]
    assert len(got) == 302 * 32 and {r["n"] for r in got} == {302}
    for c in range(32):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        z = np.array([mine[k]["whitened"] for k in keys])
        sign = np.sign(z @ want[:, c])
        assert np.abs(z * sign - want[:, c]).max() < 1e-8
        assert mine[0]["explained"] == pytest.approx(values[c] / np.trace(d.T @ d / n), rel=1e-9)
    assert all(r["deviation"] == int(((n * x[keys.index(r["vec_id"])] - total) ** 2).sum()) for r in got)
    assert {r["identity_error"] for r in got}.pop() < 1e-10


def test_whitening_edges(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, 0, None)]) == []
    assert whitened(spark, [(1, 0, [0.5, 0.25])] * 5) == []  # no variance at all
    line = whitened(spark, [(i, 0, [float(i), 2.0 * i, 1.0]) for i in range(10)])
    assert len(line) == 10 and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-9
    few = whitened(spark, [(i, 0, [float(i % 3), float(i % 5)]) for i in range(30)], most=1)
    assert {r["component"] for r in few} == {1}
    wide = whitened(spark, [(1, 0, [1e30, 1.0]), (2, 0, [-1e30, 2.0]), (3, 0, [0.0, 9.0])])
    assert {r["deviation"] for r in wide if r["vec_id"] < 3} == {None}
    doubles = whitened(spark, [(1, [1.5, 2.0]), (2, [1.0, 4.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(doubles) == 6
