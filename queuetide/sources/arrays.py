"""The elements of one large JSON array, read in byte ranges by many tasks.

A file is cut behind a character, a closing brace or a line's end, so a task that begins in
the middle of it knows neither whether it is inside a string nor how deep. Both follow from
what lies before: a first pass counts per byte range the quotes, and the change of depth for
either case; a running sum over the ranges of a file, one row each, gives every range its
beginning, and its first byte's place, which is not the range's edge. The second pass cuts
elements out and stores nothing; those that a range's edge cuts in two, if there are any,
are put together from a third.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
A_LINE, PIECE = 8, 2 << 20
_QUOTE = 1
_KINDS = bytes(_QUOTE if c == '"' else 2 if c in "{[" else 3 if c in "}]" else 0 for c in map(chr, range(256)))
_STEP = np.array([0, 0, 1, -1], np.int8)


def _ranges(batches: Iterator[pa.RecordBatch], cut: bytes) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Texts of consecutive fragments of one byte range, about ``PIECE`` bytes each, what cut them put back."""
    for batch in batches:
        file, block, n = batch.column("file"), batch.column("block"), batch.num_rows
        if not n:
            continue
        differs = pc.or_(pc.not_equal(block[1:], block[:-1]), pc.not_equal(file[1:], file[:-1])) if n > 1 else pa.array([], pa.bool_())
        change = [0, *(np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        few = max(1, n * PIECE // max(1, batch.nbytes))
        change = [*(k for a, b in zip(change, change[1:]) for k in range(a, b, few)), n]
        parts = pa.ListArray.from_arrays(pa.array(change, pa.int32()), batch.column("value").cast(pa.binary()))
        for a, text in zip(change, pc.binary_join(parts, pa.scalar(cut, pa.binary()))):
            yield (file[a].as_py(), block[a].as_py()), text.as_py() + cut


def _escaped(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` stand behind an odd number of backslashes. No range begins behind one."""
    slash = np.flatnonzero(data == ord("\\"))
    first = np.diff(slash, prepend=-2) != 1
    run = np.arange(len(slash)) - np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
    last = np.minimum(np.searchsorted(slash, at - 1), len(slash) - 1)
    return (slash[last] == at - 1) & (run[last] % 2 == 0)


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of unescaped quotes and all braces and brackets: the places, the change of depth (a quote's is 0), and whether
    an odd number of quotes lies before a brace; and the number of quotes."""
    kind = np.frombuffer(text.translate(_KINDS), np.uint8)
    at = np.flatnonzero(kind != 0)
    kind = kind[at]
    if b"\\" in text:
        left = ~((kind == _QUOTE) & _escaped(np.frombuffer(text, np.uint8), at))
        at, kind = at[left], kind[left]
    quote = kind == _QUOTE
    return at, _STEP[kind], np.bitwise_xor.accumulate(quote.view(np.uint8)), int(np.count_nonzero(quote))


def _measure(batches: Iterator[pa.RecordBatch], cut: bytes) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}  # of the byte ranges of one task
    for key, text in _ranges(batches, cut):
        _, step, odd, quotes = _marks(text)
        held = found.setdefault(key, [0, 0, 0, 0])
        out = int(step[odd == held[0] % 2].sum())
        held[1] += out
        held[2] += int(step.sum()) - out
        held[0] += quotes
        held[3] += len(text)
    if found:
        yield pa.RecordBatch.from_pydict({
            "file": [k[0] for k in found], "block": [k[1] for k in found],
            **{name: [v[i] for v in found.values()] for i, name in enumerate(("quotes", "out", "within", "size"))}})


class _Cutter:
    """Cuts the elements out of one byte range that comes piece by piece."""

    def __init__(self, inside: int, depth: int, at: int):
        self.inside, self.depth, self.at = inside, depth, at
        self.held: list[bytes] = []
        self.kind, self.place = (MIDDLE, at) if depth >= 2 else (None, at)

    def feed(self, text: bytes) -> tuple[np.ndarray, pa.Array, list[tuple[int, int, bytes]]]:
        """The elements within ``text``, their places before them; behind them what began earlier and ends here, if anything does."""
        at, step, odd, quotes = _marks(text)
        brace = (step != 0) & (odd == self.inside)
        at, step = at[brace], step[brace]
        depth = self.depth + np.cumsum(step)
        begin, end, ended = at[(step > 0) & (depth == 2)], at[(step < 0) & (depth == 1)] + 1, []  # they take turns
        if self.kind is not None:
            self.held.append(text[:end[0]] if len(end) else text)
            if len(end):
                ended = [(WHOLE if self.kind == TAIL else HEAD, self.place, b"".join(self.held))]
                self.kind, self.held, end = None, [], end[1:]
        if len(begin) > len(end):
            self.kind, self.place, self.held = TAIL, self.at + int(begin[-1]), [text[begin[-1]:]]
            begin = begin[:-1]
        place = self.at + begin
        self.at += len(text)
        self.inside ^= quotes & 1
        self.depth += int(step.sum())
        return place, _slices(text, begin, end), ended

    def rest(self) -> list[tuple[int, int, bytes]]:
        return [(self.kind, self.place, b"".join(self.held))] if self.kind is not None else []


def _slices(text: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The parts of ``text`` from each ``begin`` to its ``end``."""
    if not len(begin):
        return pa.array([], pa.string())
    edges = np.column_stack((begin, end)).astype(np.int32).ravel()
    found = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(text)).take(pa.array(np.arange(0, len(edges), 2)))
    found.validate(full=True)
    return found


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array that holds what comes, a few elements a line."""
    def lines(values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()) if isinstance(values, list) else values], ["value"])

    yield lines(["["])
    begun = False
    for batch in batches:
        n = batch.num_rows
        if n:
            few = pa.ListArray.from_arrays(pa.array([*range(0, n, A_LINE), n], pa.int32()), batch.column(0).cast(pa.string()))
            joined = pc.binary_join(few, ",")
            marks = pa.array(["," if begun else " ", *[","] * (len(joined) - 1)])
            begun = True
            yield lines(pc.binary_join_element_wise(marks, joined, ""))
    yield lines(["]"])


def write_array(df: DataFrame, element: str, path: str) -> None:
    """Column ``element`` (JSON texts; nulls are left out) as files below ``path``, each one JSON array.

    Every task streams its rows into one file, so arrays are as long as a task's share and
    nothing holds one whole. A line has ``A_LINE`` elements at most.
    """
    df.where(F.col(element).isNotNull()).select(element).mapInArrow(_lines, "value string").write.text(path)


def array_elements(spark: SparkSession, path: str, cut: str = "}") -> DataFrame:
    """(file, position, element): the objects and arrays in the JSON array of each file below ``path``, as text.

    A position is the byte in the file where the element begins. Files of any size are read in ranges of
    ``spark.sql.files.maxPartitionBytes``; an element may be longer than a range. Scalars in
    the array are left out; a file with another root than an array is not for this.
    The driver sees three numbers per byte range.

    Ranges begin behind ``cut``, one character that is neither a quote nor a backslash. Any
    gives the same elements; what lies between two is held as one text, so it has to come
    often. A closing brace does in any array of objects; where lines are short, as in those
    of ``write_array``, a line's end is several times as fast.
    The files are read whenever the result is, so they must stay while it is in use.
    """
    sep = cut.encode()
    fragments = spark.read.option("lineSep", cut).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    measured = fragments.mapInArrow(lambda batches: _measure(batches, sep), "file string, block long, quotes long, out long, within long, size long")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begins = (measured.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
              .withColumn("change", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("within")))
              .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
              .withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))).collect()
    begin = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["inside"], r["depth"], r["at"]) for r in begins})

    def fed(batches: Iterator[pa.RecordBatch]):
        """What the cutter of each byte range makes of every text, and of its end."""
        key, cutter = None, None
        for here, text in _ranges(batches, sep):
            if here != key:
                if cutter:
                    yield key, np.array([], np.int64), pa.array([], pa.string()), cutter.rest()
                key, cutter = here, _Cutter(*begin.value[here])
            yield key, *cutter.feed(text)
        if cutter:
            yield key, np.array([], np.int64), pa.array([], pa.string()), cutter.rest()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, _), place, elements, others in fed(batches):
            late = [o for o in others if o[0] == WHOLE]
            if late:
                place = np.append(place, [o[1] for o in late])
                elements = pa.concat_arrays([elements, pa.array([o[2].decode() for o in late], pa.string())])
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(place)), pa.array(place, pa.int64()), elements], ["file", "position", "element"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), _, _, others in fed(batches):
            for kind, place, text in others:
                if kind != WHOLE:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([place]), pa.array([kind], pa.int32()), pa.array([text.decode()])],
                                                     ["file", "block", "place", "kind", "text"])

    elements = fragments.mapInArrow(whole, "file string, position long, element string")
    torn = sorted({r["file"] for r in begins if r["depth"] >= 2})
    if not torn:
        return elements
    # At most two pieces per byte range: the end of an element from before, and the beginning of one.
    so_far = W.partitionBy("file").orderBy("block", F.col("kind") == TAIL).rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = (fragments.where(F.col("file").isin(torn)).mapInArrow(parts, "file string, block long, place long, kind int, text string")
              .withColumn("of", F.count_if(F.col("kind") == TAIL).over(so_far)))
    joined = pieces.groupBy("file", "of").agg(
        F.min(F.when(F.col("kind") == TAIL, F.col("place"))).alias("position"),
        F.count_if(F.col("kind") == HEAD).alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("last"), "text"))),
                                 lambda p: p["text"]), "").alias("element"))
    return elements.unionByName(joined.where("position is not null and ends = 1").select("file", "position", "element"))
