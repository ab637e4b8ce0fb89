"""The operators as queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("op1_token_files")
def token_files(spark, sf):
    from .token_files import token_round_trip

    return token_round_trip(spark, documents(spark, sf))


@query("op3_document_fingerprints")
def document_fingerprints(spark, sf):
    from .fingerprints import compare_with_next

    return compare_with_next(documents(spark, sf))


@query("op9_packing")
def packing(spark, sf):
    from .packing import pack_documents, piece_digests

    return piece_digests(pack_documents(documents(spark, sf)))


@query("op5_substring_dedup")
def substring_dedup(spark, sf):
    from .substrings import kept_digests, remove_repeats

    return kept_digests(remove_repeats(documents(spark, sf)))


@query("op4_minhash_near_dedup")
def minhash_near_dedup(spark, sf):
    from .near import near_groups

    return near_groups(documents(spark, sf), words=3, percent=85)


@query("op6_language_id")
def language_id(spark, sf):
    from pyspark.sql import functions as F

    from .common import crc32_of_id
    from .language import fit_filters, predict_language

    docs = documents(spark, sf)
    held_out = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))
    found = predict_language(docs, fit_filters(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def toxicity(spark, sf):
    from .toxicity import score_toxicity

    return score_toxicity(documents(spark, sf), spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet"))


@query("op10_secret_scan")
def secret_scan(spark, sf):
    from .secrets import find_secrets

    return find_secrets(documents(spark, sf))


def _lines_sql() -> str:
    from .lines import ORACLE

    return ORACLE


@query("op2_line_dedup", _lines_sql())
def line_dedup(spark, sf):
    from .lines import remove_line_runs

    return remove_line_runs(documents(spark, sf)).drop("removed")


@query("op8_benchmark_leaks")
def benchmark_leaks(spark, sf):
    from .decontaminate import find_leaks

    return find_leaks(documents(spark, sf), spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet"))


@query("pipeline")
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)


def _embeddings(spark, sf):
    return spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet")


@query("op11_hard_negatives", """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
pairs as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike,
    cast(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select * from pairs where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as int) as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.alike
  and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) <= 5""")
def hard_negatives(spark, sf):
    from pyspark.sql import functions as F

    from .negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_embeddings(spark, sf).withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op12_embedding_whitening")
def embedding_whitening(spark, sf):
    from .whitening import whiten

    return whiten(_embeddings(spark, sf))


@query("op13_token_counts")
def token_counts(spark, sf):
    """Starts from an empty cache, so that every distinct text is encoded."""
    from pyspark.sql import functions as F

    from .common import fresh_path
    from .token_counts import count_tokens

    counts = count_tokens(documents(spark, sf), fresh_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
