"""Language of a text by n-gram filters whose rows are language bitmasks.

Training counts byte 4-grams per language over all labelled rows. A language's filter
holds the grams that are about as frequent in it as in any language. The filters are one
bit-sliced Bloom filter: every position holds one bit per language, so the AND of a gram's
positions names all languages that contain it at once. A text's grams are counted per
language, the share that chance gives a filter is taken out, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, slices, written
from .words import mix, text_bytes

GRAM, HASHES = 4, 4
MIN_RATE = 2e-6  # so a language has 500,000 grams at most: rates sum to one
LIKE_BEST = 0.3  # a gram belongs to the languages with this part of its highest rate
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams of each text and the text each is from; all but letters is a space.

    A gram stays in its text and has a letter at its second byte, so gaps between words
    count once.
    """
    data, offsets = text_bytes(column)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (text[:-3] == text[3:]) & (b[1:-2] != 0x20)
    return code[ok], text[:-3][ok]


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  # positions x words of 64 languages
    chance: np.ndarray  # per language: part of foreign grams that seem to be in its filter
    usual: int  # the language of texts without a known gram

    def masks(self, codes: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.rows) - 1)
        out = np.full((len(codes), self.rows.shape[1]), np.uint64(2**64 - 1))
        wide = codes.astype(np.uint64)
        for k in range(HASHES):
            out &= self.rows[(mix(wide, 40 + k) & size).astype(np.int64)]
        return out

    def shares(self, column: pa.Array) -> np.ndarray:
        """Texts x languages: part of a text's grams in each filter, corrected for chance."""
        codes, text = grams(column)
        n = len(column)
        total = np.bincount(text, minlength=n)
        distinct, back = np.unique(codes, return_inverse=True)
        masks = self.masks(distinct)
        out = np.zeros((n, len(self.languages)))
        for l in range(len(self.languages)):
            inside = (masks[:, l // 64] >> np.uint64(l % 64) & np.uint64(1)).astype(np.float64)
            hits = np.bincount(text, weights=inside[back], minlength=n)
            out[:, l] = np.maximum(hits / np.maximum(total, 1) - self.chance[l], 0) / (1 - self.chance[l])
        return out


def fit_filters(docs: DataFrame, min_rate: float = MIN_RATE, like_best: float = LIKE_BEST) -> Filters:
    """From the rows whose ``text`` and ``lang`` are not null; all of them are counted.

    Rows that repeat count each time; languages with equal figures go by their names. Other
    columns are not read, and an empty table gives filters that know no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, size=8 * MB):
            codes, text = grams(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            lang = names.indices.to_numpy()[text]
            for l, name in enumerate(names.dictionary.to_pylist()):
                new, n = np.unique(codes[lang == l], return_counts=True)
                if name in held:
                    both = np.concatenate([held[name][0], new])
                    new, back = np.unique(both, return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([held[name][1], n])).astype(np.int64)
                held[name] = new, n
        for name, (codes, n) in held.items():
            for a in range(0, len(codes), 100_000):
                part = codes[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[a:a + 100_000])],
                                                 names=["lang", "gram", "n"])

    counts = (docs.select("text", "lang").where("text is not null and lang is not null")
              .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("of"))
    kept = written(by_gram, "grams")
    totals = {r["lang"]: r["n"] for r in kept.select(F.explode("of").alias("o")).groupBy("o.lang").agg(F.sum("o.n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    rate = F.create_map(*[F.lit(x) for l in languages for x in (l, float(totals[l]))])
    rates = F.transform("of", lambda o: F.struct(o["lang"].alias("lang"), (o["n"] / rate[o["lang"]]).alias("r")))
    best = F.array_max(F.transform("rates", lambda o: o["r"]))
    chosen = (kept.select("gram", rates.alias("rates"))
              .select("gram", F.filter("rates", lambda o: (o["r"] >= min_rate) & (o["r"] >= like_best * best)).alias("rates"))
              .where(F.size("rates") > 0).select("gram", F.transform("rates", lambda o: o["lang"]).alias("langs")))
    found = chosen.toPandas()  # 1 / min_rate rows per language at most
    size = 1 << int(max(16, 8 * len(found))).bit_length()
    rows = np.zeros((size, (len(languages) + 63) // 64), np.uint64)
    at = {l: i for i, l in enumerate(languages)}
    lengths = found["langs"].map(len).to_numpy()
    codes = np.repeat(found["gram"].to_numpy().astype(np.uint64), lengths)
    lang = np.array([at[l] for ls in found["langs"] for l in ls], np.int64)
    for k in range(HASHES):
        np.bitwise_or.at(rows, ((mix(codes, 40 + k) & np.uint64(size - 1)).astype(np.int64), lang // 64),
                         np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([(rows[:, l // 64] >> np.uint64(l % 64) & np.uint64(1)).mean() for l in range(len(languages))])
    return Filters(languages, rows, fill ** HASHES, max(range(len(languages)), key=lambda l: totals[languages[l]]))


def predict_language(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score (the best language's part of all shares) of each row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Ties go to the first language by name; a text without a known gram gets the most
    frequent language with score 0. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        model = shared.value
        for batch in slices(batches, size=2 * MB):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            if model.languages:
                shares = model.shares(batch.column("text"))
                top, total = shares.argmax(axis=1), shares.sum(axis=1)
                top[total == 0] = model.usual
                score = np.where(total > 0, shares.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                names = np.array(model.languages, object)[top]
                names[~letters], score[~letters] = "und", 0.0
            else:
                names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, "doc_id long, lang_pred string, score double")
