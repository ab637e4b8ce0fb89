"""Near-duplicates by bottom-k sketches of word shingles.

One hash function orders the shingles of every text; a sketch is the ``K`` smallest. Equal
sets are put together first. Of a sketch the rarest values go into inverted lists: two
sketches that share as many values as similar texts do (all but one pair in ten million)
must meet in a list of the rarest K - t + 1, and there the words of common passages hardly
ever are. Texts that meet, directly or over others, form a cluster; each cluster's texts
travel together once, large clusters in pairs of blocks. In a block, shingles that are rare
there name candidates, the sketch of the union estimates their similarity, and what is not
clearly below is settled on the full sets. Pairs already connected are skipped, so a group
of n copies gives n - 1 links, not n squared.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, slices, written
from .components import components
from .words import shingle_hashes, split_words

K = 32
UNION_K = 64
MISS = 1e-7  # of a pair right at the threshold
BLOCK_SHINGLES, BLOCK_TEXTS = 1_000_000, 1500


def needed_overlap(share: float, k: int = K, miss: float = MISS) -> int:
    """The most values t such that sketches of sets with similarity ``share`` share fewer with chance <= miss."""
    tail = 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * share ** t * (1 - share) ** (k - t)
        if tail > miss:
            return max(1, t)
    return k


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    hashes, first = shingle_hashes(split_words(column, lower=True), words)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = UNION_K) -> tuple[float, int]:
    """Similarity of two sorted sets by the bottom-k sketch of their union, and that sketch's size."""
    a, b = a[:k], b[:k]
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = np.append(True, ~twice)
    upto = both[distinct][:k]
    return float((both[1:][twice] <= upto[-1]).sum()) / len(upto), len(upto)


def similar_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets whose Jaccard similarity is percent/100 or more.

    With ``side`` only pairs across the two sides are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.lexsort((codes, counts[codes], owner))
    codes, begin = codes[rarity], np.cumsum(sizes) - sizes
    prefix = sizes - (sizes * percent + 99) // 100 + 1
    share = percent / 100
    slack = 6 * math.sqrt(share * (1 - share))
    postings: dict[int, list[int]] = {}
    links, label = [], np.arange(n)
    for x in np.argsort(sizes, kind="stable").tolist():
        head = codes[begin[x]:begin[x] + prefix[x]]
        head = head[counts[head] > 1].tolist()
        met = [p for p in (postings.get(c) for c in head) if p]
        if met:
            near, times = np.unique(np.concatenate([np.array(p) for p in met]), return_counts=True)
            ok = (label[near] != label[x]) & (sizes[near] * 100 >= percent * sizes[x])
            if side is not None:
                ok &= side[near] != side[x]
            near = near[ok][np.argsort(-times[ok], kind="stable")]
            for y in near.tolist():
                if label[y] == label[x]:
                    continue
                estimate, k = union_estimate(sets[x], sets[y])
                if estimate < share - slack / math.sqrt(k):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    links.append((x, y))
                    label[label == label[y]] = label[x]
        for c in head:
            postings.setdefault(c, []).append(x)
    return links


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, text_hash: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Texts are linked where their sets of distinct ``words``-word shingles (shorter texts:
    all words as one) have a Jaccard similarity of percent/100 or more. component_id is the
    smallest doc_id that can be reached, itself included; kept marks the row that has it.
    Null and wordless texts have no shingles and no links; a row without a doc_id has no
    links either, a null component_id, and is kept. Rows are the unit: of rows that share a
    doc_id with different texts each is linked by its own text and kept or not by itself,
    so to drop what is not kept, drop by doc_id and text; ``text_hash`` names a column with
    the text's xxhash64 for that. Rows equal in both stay or go together. Only doc_id and
    text are read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    hashed = [F.xxhash64("text").alias(text_hash)] if text_hash else []

    def sketch(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            low = [s[:K].view(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            own = [batch.column(text_hash)] if text_hash else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *own, pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(low)))],
                names=["doc_id", *named, "n_shingles", "set_id", "sketch"])

    named = [text_hash] if text_hash else []
    schema = "".join(f"{c} long, " for c in ["doc_id", *named, "n_shingles"]) + "set_id binary, sketch array<long>"
    sketches = written(docs.select("doc_id", "text", *hashed).mapInArrow(sketch, schema), "sketches")
    linked = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(linked.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes, (linked.set_id == classes.set_id) & (linked.doc_id == classes.rep)).select("rep", "sketch")

    least = needed_overlap(percent / 100)
    values = written(reps.select("rep", F.size("sketch").alias("k"), F.explode("sketch").alias("v")), "values")
    common = values.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    shared = values.join(common, "v").groupBy("rep").agg(
        F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("n", "v"))).alias("shared"))
    # A value no one else has takes its place among the rarest, too.
    quota = F.col("k") - F.greatest(F.floor(F.col("k") * least / K), F.lit(1)) + 1 - (F.col("k") - F.size("shared"))
    lists = written(shared.withColumn("quota", quota.cast("int")).where("quota > 0")
                    .select("rep", F.explode(F.slice("shared", F.lit(1), F.col("quota"))).alias("s")).select("rep", "s.v"), "lists")
    hubs = lists.groupBy("v").agg(F.min("rep").alias("hub"))
    clusters = components(lists.join(hubs, "v").select(F.col("rep").alias("a"), F.col("hub").alias("b")))

    members = clusters.join(linked.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    blocks = members.groupBy("component").agg(F.greatest(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "component").select(
        "node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).distinct()
    placed = docs.join(placed, docs.doc_id == placed.node).select("doc_id", "text", "component", "blocks", "block")
    placed = placed.select("doc_id", "text", "component", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    dealt = placed.select("component", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "doc_id", "block", "text")

    def settle(table: pa.Table):
        ids = table.column("doc_id").to_numpy()
        if len(ids) < 2:
            return
        sets = shingle_sets(table.column("text"), words)
        block = table.column("block").to_numpy()
        side = block if block[0] != block[-1] or len(np.unique(block)) > 1 else None
        links = [(x, y) for x, y in similar_links(sets, side, percent) if ids[x] != ids[y]]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(ids[[x for x, _ in links]]), pa.array(ids[[y for _, y in links]])],
                                             names=["a", "b"])

    links = written(grouped(dealt, ["component", "i", "j"], settle, "a long, b long"), "links")
    found = components(links)
    of_set = classes.join(found, classes.rep == found.node, "left").select(
        F.col("set_id").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    out = sketches.join(of_set, (sketches.set_id == of_set._set) & (sketches.n_shingles > 0), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", *named, "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
