"""Removal of repeated line runs, by a suffix array over line ids.

A document is the sequence of its lines' ids. Lines that occur once end every repeat, so
only the others' positions are suffixes. Prefix doubling ranks them: rank 1 + the number of
smaller suffixes by their first line, then by 2, 4, ... lines, each round from the pair
(rank here, rank that many lines on). Suffixes of equal rank at a depth are an interval
whose longest common prefix is at least that deep; its earliest suffix stays, and the lines
that the others share with it are later copies.

Each round refines groups by counts of (rank, next rank), which are summed before they are
shuffled, so a line that a third of all rows hold costs no window over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

MIN_LINES, LONG_WORDS = 3, 10
BUCKETS = 1 << 12  # of first ranks


def word_count(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def line_positions(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line (from 0), two independent 64-bit hashes, words."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.select("doc_id", F.col("line").cast("int").alias("line"), F.xxhash64("content").alias("h1"),
                        F.xxhash64(F.lit(1), "content").alias("h2"), word_count(F.col("content")).alias("words"))


def _first_ranks(repeated: DataFrame) -> DataFrame:
    """(h1, h2, n) with ``rank``: 1 + the suffixes whose first line is smaller, in hash order."""
    bucket = F.shiftrightunsigned("h1", 64 - 12).cast("int")
    with_bucket = repeated.withColumn("bucket", bucket)
    totals = with_bucket.groupBy("bucket").agg(F.sum("n").alias("t"))  # BUCKETS rows at most
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = with_bucket.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(totals, "bucket").select("h1", "h2", (F.col("base") + F.col("inner") + 1).alias("rank"))


def deepen(ranks: DataFrame, have: int, want: int) -> DataFrame:
    """Ranks by the first ``want`` lines from those by ``have`` (want <= 2 * have)."""
    ahead = ranks.select("doc_id", (F.col("line") - (want - have)).alias("line"), F.col("rank").alias("ahead"),
                         F.col("whole").alias("ahead_whole"))
    pairs = written(ranks.join(ahead, ["doc_id", "line"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(0))), "pairs")
    counts = pairs.groupBy("rank", "ahead").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("rank").orderBy("ahead").rowsBetween(Window.unboundedPreceding, -1)
    finer = counts.select("rank", "ahead", (F.col("rank") + F.coalesce(F.sum("n").over(smaller), F.lit(0))).alias("finer"))
    out = written(pairs.join(finer, ["rank", "ahead"]).select(
        "doc_id", "line", "words", F.col("finer").alias("rank"), (F.col("whole") & F.coalesce("ahead_whole", F.lit(False))).alias("whole")), "ranks")
    dropped(pairs)
    return out


def suffix_ranks(lines: DataFrame, depth: int) -> list[tuple[int, DataFrame]]:
    """(depth, ranks) for 1, 2, 4, ... and at last ``depth`` lines.

    ranks: doc_id, line, words, rank, and ``whole``: the suffix has that many repeated lines.
    """
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    first = lines.join(_first_ranks(counts), ["h1", "h2"]).select("doc_id", "line", "words", "rank", F.lit(True).alias("whole"))
    levels = [(1, written(first, "ranks"))]
    while levels[-1][0] < depth:
        have, ranks = levels[-1]
        want = min(2 * have, depth)
        levels.append((want, deepen(ranks, have, want)))
    return levels


def later_copies(ranks: DataFrame, where: Column, depth: int) -> DataFrame:
    """(doc_id, line, depth) of suffixes that share ``depth`` lines with an earlier one."""
    place = F.struct("doc_id", "line")
    able = ranks.where(F.col("whole") & where)
    first = able.groupBy("rank").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return able.join(first, "rank").where(place > F.col("first")).select("doc_id", "line", F.lit(depth).alias("depth"))


def remove_line_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS,
                     also: tuple[str, ...] = ()) -> DataFrame:
    """Texts without later copies of repeated line runs.

    A run counts if it has ``min_lines`` lines, or is one line of ``long_words`` words or
    more. Its copies are all but the earliest (smallest doc_id, then smallest line); each
    line of a copy goes. Lines are what stands between newlines, compared exactly; shorter
    repeats stay. Columns: doc_id, n_lines, n_removed, text (kept lines joined by newlines),
    removed: the removed lines' numbers from 0, in order; and the columns of ``docs`` named
    in ``also``, as they are. Others are not read.

    A null text has no lines and stays null; an empty one has one empty line. A row without
    a doc_id keeps all its lines and is nobody's earlier copy. Rows that repeat a doc_id are
    versions of one document: what is a copy in one goes from all, none is the other's copy.
    """
    docs = docs.select("doc_id", "text", *also)
    lines = line_positions(docs.where("doc_id is not null and text is not null"))
    levels = suffix_ranks(lines, min_lines)
    copies = later_copies(levels[0][1], F.col("words") >= long_words, 1)
    if min_lines > 1:
        copies = copies.unionByName(later_copies(levels[-1][1], F.lit(True), min_lines))
    else:
        copies = copies.unionByName(later_copies(levels[0][1], F.lit(True), 1))
    gone = (copies.groupBy("doc_id").agg(F.collect_set(F.struct("line", "depth")).alias("runs"))
            .select(F.col("doc_id").alias("_doc"), F.array_sort(F.array_distinct(F.flatten(F.transform(
                "runs", lambda r: F.sequence(r["line"], r["line"] + r["depth"] - 1))))).alias("_gone")))
    out = docs.join(gone, docs.doc_id == gone._doc, "left")
    split = F.split("text", "\n")
    removed = F.filter(F.coalesce("_gone", F.array().cast("array<int>")), lambda i: i < F.size(split))
    keep = F.concat_ws("\n", F.filter(split, lambda _, i: ~F.array_contains("_gone", i)))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
                      F.when(F.col("_gone").isNull(), F.col("text")).otherwise(keep).alias("text"), removed.alias("removed"), *also)


ORACLE = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as content,
    unnest(range(len(string_split(text, chr(10))))) as line
  from documents where text is not null and doc_id is not null),
counted as (
  select *, len(list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words,
    lead(content, 1) over d as b, lead(content, 2) over d as c
  from lines window d as (partition by doc_id order by line)),
single as (
  select doc_id, line, row_number() over (partition by content order by doc_id, line) as nth
  from counted where words >= 10),
triple as (
  select doc_id, line, row_number() over (partition by content, b, c order by doc_id, line) as nth
  from counted where b is not null and c is not null),
gone as (
  select distinct doc_id, line from (
    select doc_id, line from single where nth > 1
    union all select doc_id, line + k from triple, (values (0), (1), (2)) v(k) where nth > 1))
select d.doc_id, count(l.line) as n_lines, count(g.line) as n_removed,
  case when any_value(d.text) is null then null
       else coalesce(string_agg(case when g.line is null then l.content end, chr(10) order by l.line), '') end as text
from documents d left join lines l on d.doc_id = l.doc_id left join gone g on l.doc_id = g.doc_id and l.line = g.line
group by d.doc_id
"""
