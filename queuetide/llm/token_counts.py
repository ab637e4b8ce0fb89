"""Token counts of whole texts through a cache of digests.

Each text gets a digest of its normalised content, the form that the tokenizer's own
normaliser gives it, so texts that differ in white space or case alone share one where
the tokenizer ignores both. The cache is a Parquet table of (version, digest, n_tokens),
where version is a digest of the tokenizer's file and of the library's version. Texts
whose digest has no count yet are encoded, one of each digest, and their counts appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import APART, DIGIT, KIND, MEMO, SPACE, tokenizer_path
from .words import LOWER, text_bytes

CACHE = "digest binary, n_tokens long, version string"
# Here spaces and digits are apart from everything, too.
_CUT = APART.copy()
_CUT[DIGIT, DIGIT] = True
_CUT[SPACE, :] = _CUT[:, SPACE] = True
_CUT[SPACE, SPACE] = False
# Fixed value: the word rule of word-end vocabularies. No match holds white space, none looks around.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    whole = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as f:
        whole.update(f.read())
    return whole.hexdigest()


class TokenCounter:
    """Digests and counts by the library's own result: no added tokens, no truncation."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[bytes, int] = {}
        self.pieces = self.normaliser = None
        self.special: list[str] = []
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normaliser = self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            written = json.load(f)
        split = (written.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [n.get("type") for n in (written.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (split.get("behavior"), split.get("invert"), split.get("pattern")) == (
            "Removed", True, {"Regex": _WORD_RULE}) and steps == ["NFC", "Replace", "Lowercase"] and all(
            re.fullmatch(r"<\|[a-z]+\|>", s) for s in self.special)

    def digest(self, text: str) -> bytes:
        """Equal digests have equal counts: a special string is looked for before normalising, so it keeps its text raw."""
        if self.normaliser is not None and not any(s in text for s in self.special):
            return hashlib.blake2b(self.normaliser.normalize_str(text).encode(), digest_size=16, person=b"normalised").digest()
        return hashlib.blake2b(text.encode(), digest_size=16, person=b"raw").digest()

    def _encoded(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; a null text is empty.

        Where the tokenizer looks for words by the known rule, a piece that it encodes never
        reaches over a space, nor from an ASCII letter, digit or mark to one of another kind,
        nor from digit to digit. Texts are cut there, and equal pieces are encoded once.
        """
        if not self.by_word:
            return np.array(self._encoded([t or "" for t in column.to_pylist()]), np.int64)
        data, offsets = text_bytes(column)
        n = len(data)
        if n == 0:
            return np.zeros(len(column), np.int64)
        lowered = LOWER[data]
        if not any(s.encode() in lowered.tobytes() for s in self.special):
            # A letter before a byte that is not ASCII may be joined with it, as a capital or not at all.
            data = np.where(np.append(data[1:] < 0x80, True), lowered, data)
        kind = KIND[data]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = _CUT[kind[:-1], kind[1:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
            None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [c for c in distinct if c not in self.memo]
        for a in range(0, len(new), 4096):
            some = new[a:a + 4096]
            self.memo.update(zip(some, self._encoded([c.decode() for c in some])))
        sizes = np.array([self.memo[c] for c in distinct], np.int64)[chunks.indices.to_numpy()]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.searchsorted(bounds, offsets)
        return before[at[1:]] - before[at[:-1]]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; writers at the same time may have added a digest twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(folder).where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row; ``cache`` is a folder all executors reach, made when absent.

    A null text is empty and has no tokens. Rows that share a doc_id, or have none, are
    counted each on their own; repeated rows and copies are encoded once. Only doc_id and
    text are read. An empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    version = tokenizer_version(path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, offsets = text_bytes(batch.column("text"))
            digest = counter(path).digest
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array([digest(t) for t in batch.column("text").to_pylist()], pa.binary())],
                names=["doc_id", "h", "n_bytes", "digest"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counter(path).counts(batch.column("text")))],
                                             names=["digest", "n_tokens"])

    rows = written(texts.mapInArrow(digests, "doc_id long, h long, n_bytes long, digest binary"), "digests")
    # One row stands for all of a digest: the row that gets encoded where the cache has no count.
    stand = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    misses = stand.join(read_cache(spark, cache, version), "digest", "left_anti").select(
        "digest", F.col("r.doc_id").alias("_doc"), F.col("r.h").alias("_h"))
    chosen = texts.join(misses, texts.doc_id.eqNullSafe(F.col("_doc")) & (texts.h == F.col("_h"))).select("digest", "text")
    new = chosen.mapInArrow(counted, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)

    # One row per digest, written, so that a join with a hot digest can be split.
    known = read_cache(spark, cache, version).join(stand.select("digest"), "digest", "left_semi")
    known = written(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")
