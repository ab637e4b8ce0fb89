"""From documents to packed training sequences: five stages, each over all that the last one kept.

Rows are the unit: those without a doc_id, with a repeated one, or repeated as a whole are
judged each by their text, but that rows of one doc_id are never copies of one another,
and rows without one are nobody's copies. Null texts have no words and no lines; they
pass all stages and are packed as one end id. Columns beyond those of ``documents`` are left
behind at the first stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuetide.llm.common import documents, written
from queuetide.llm.decontaminate import without_leaks
from queuetide.llm.lines import remove_line_runs
from queuetide.llm.near import near_groups
from queuetide.llm.packing import pack_documents, piece_digests
from queuetide.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict as toxic."""
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that has nothing else left goes."""
    cut = remove_line_runs(docs, also=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    left = F.trim(F.translate("text", "\n\t\r", "   ")) != ""
    return cut.where(~changed | left).select("doc_id", "text", "lang", "source", F.when(
        changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with a similarity of 0.8 or more over five-word shingles, and their chains, the one with the smallest doc_id.

    Rows go by doc_id and text: where rows share a doc_id, a text stays that no other row holds.
    """
    gone = near_groups(docs, words=5, percent=80, text_hash="_hash").where("not kept").select(
        F.col("doc_id").alias("_gone"), "_hash").distinct()
    here = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    return here.join(gone, (here.doc_id == gone._gone) & (here._text == gone._hash), "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 ids."""
    return piece_digests(pack_documents(docs))


STAGES = [("toxicity", not_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", one_of_each_group),
          ("decontamination", without_benchmark), ("packing", packed)]

# A trained classifier, sketches and byte-pair encoding are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
