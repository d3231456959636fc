"""JSON array files read by many tasks, and written.

Spark reads a file of one JSON array in one task, as a border between records can
only be told from what stands before it. Here a file is read as text that ends at
commas. Those pieces are cut by Spark like lines, so a piece is never divided, and
a backslash is in one piece with the quote that it escapes. Each split is summed up
first: whether it has an odd number of quotes, and how many brackets deeper it ends,
for either case of its beginning. Running totals over the splits say in what state
each begins, and a second reading cuts each into records. What a split begins or
ends inside of is put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.plans.storage import pinned

#: Splits whose states are broadcast, some 100 bytes each; of more, text is sorted.
MOST_BROADCAST = 500_000
_SUMMARY = "file string, block bigint, flips bigint, deeper0 bigint, deeper1 bigint, array boolean"
_PIECE = "file string, block bigint, kind int, text string"
_WHOLE, _HEAD, _TAIL = 0, 1, 2
_QUOTE, _SLASH = ord('"'), ord("\\")


def read_array_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each object or array in the arrays of ``path`` as text (``value``).

    A file may hold one array, or objects one after the other. Elements that are
    neither are left out. A file that breaks off gives its last record as far as
    it goes; after a bracket or quote too few or too many, records of that file
    are what its brackets say. Empty files give nothing.
    """
    with _same_splits(spark):
        states = pinned(_states(_pieces(spark, path).mapInArrow(_sum_up, _SUMMARY)))
        pieces = _pieces(spark, path)
        if states.count() <= MOST_BROADCAST:
            placed = pieces.join(F.broadcast(states), ["file", "block"], "left")
        else:
            placed = (
                pieces.withColumn("at", F.monotonically_increasing_id())
                .join(states, ["file", "block"], "left")
                .repartition("file", "block")
                .sortWithinPartitions("file", "block", "at")
            )
        placed = placed.select("file", "block", "value", "in_string", "depth", "base", "last")
        found = pinned(placed.mapInArrow(_cut, _PIECE))
    whole = found.filter(F.col("kind") == _WHOLE).select(F.col("text").alias("value"))
    return whole.unionByName(_joined(found.filter(F.col("kind") != _WHOLE)))


def write_array_files(records: DataFrame, value: str, order: str, path: str, files: int) -> None:
    """Write texts as JSON arrays in ``files`` files or fewer, each in order."""
    part = F.pmod(F.xxhash64(order), F.lit(files)).alias("part")
    rows = records.select(part, F.col(order).alias("_order"), F.col(value).alias("_value"))
    ends = rows.groupBy("part").agg(F.min("_order").alias("_from"), F.max("_order").alias("_to"))
    # a row per file
    framed = rows.join(F.broadcast(ends), "part").withColumn(
        "value",
        F.concat(
            F.when(F.col("_order") == F.col("_from"), "[").otherwise(""),
            F.col("_value"),
            F.when(F.col("_order") == F.col("_to"), "]").otherwise(","),
        ),
    )
    (
        framed.repartition(files, "part")
        .sortWithinPartitions("part", "_order")
        .select("part", "value")
        .write.mode("overwrite")
        .partitionBy("part")
        .text(path)
    )


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Both readings cut files alike, also if executors come or go between them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", ",")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def _states(summaries: DataFrame) -> DataFrame:
    """In what state each split begins: two rows of numbers a split, by file."""
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(expr: Column) -> Column:
        return F.coalesce(F.sum(expr).over(before), F.lit(0))

    deeper = F.when(F.col("in_string") == 1, F.col("deeper1")).otherwise(F.col("deeper0"))
    return (
        summaries.withColumn("in_string", earlier(F.col("flips")) % 2)
        .withColumn("depth", earlier(deeper))
        .withColumn("base", F.first("array").over(in_file).cast("int"))
        .withColumn("last", F.lead("block").over(in_file).isNull())
        .select("file", "block", "in_string", "depth", "base", "last")
    )


def _joined(parts: DataFrame) -> DataFrame:
    """Records that more than one split holds: one ends a split, the others go on
    from it. At most two pieces a split."""
    at = F.struct("block", "kind")
    record = F.sum((F.col("kind") == _TAIL).cast("int")).over(
        Window.partitionBy("file").orderBy("block", "kind")
    )
    pieces = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("text").alias("text"))))
    return (
        parts.withColumn("record", record)
        .groupBy("file", "record")
        .agg(pieces.alias("pieces"))
        .select(F.concat_ws("", F.col("pieces.text")).alias("value"))
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that are of one split."""
    if batch.num_rows == 0:
        return
    files = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    blocks = batch.column(1).to_numpy(zero_copy_only=False)
    changes = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
    edges = [0, *changes.tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        run = batch.slice(start, end - start)
        yield (run.column(0)[0].as_py(), run.column(1)[0].as_py()), run


def _signs(run: pa.Array, inside: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of pieces with their commas, how many quotes open or close a
    string, and of each bracket where it stands, whether that is in a string (for
    pieces that begin ``inside`` one, or not), and 1 or -1 as it opens or closes."""
    pieces = pa.ListArray.from_arrays(pa.array([0, len(run)], pa.int32()), run)
    joined = pc.binary_join(pieces, ",")[0].as_buffer()
    text = np.frombuffer(joined, np.uint8)
    quotes = np.flatnonzero(text == _QUOTE)
    slashes = np.flatnonzero(text == _SLASH)
    if len(slashes):
        # a quote is escaped where an odd number of backslashes ends before it
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(first, append=len(slashes))
        ends = slashes[first + length - 1][length % 2 == 1]
        quotes = quotes[~np.isin(quotes, ends + 1)]
    # brackets are [ ] { }, which differ in 0x20 and in 5B, 5D
    folded = text & 0xDF
    brackets = np.flatnonzero((folded == 0x5B) | (folded == 0x5D))
    in_string = (inside + np.searchsorted(quotes, brackets)) % 2
    return text, len(quotes), brackets, in_string, 0x5C - folded[brackets].astype(np.int64)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, flips, deeper, array = None, 0, [0, 0], False

    def row() -> pa.RecordBatch:
        columns = [[here[0]], [here[1]], [flips], [deeper[0]], [deeper[1]], [array]]
        types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
        names = ["file", "block", "flips", "deeper0", "deeper1", "array"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        for split, run in _runs(batch):
            if split != here:
                if here is not None:
                    yield row()
                here, flips, deeper = split, 0, [0, 0]
                array = run.column(2)[0].as_py().lstrip("﻿ \t\r\n").startswith("[")
            _, turns, _, quoted, net = _signs(run.column(2), flips % 2)
            deeper[0] += int(net[quoted == 0].sum())
            deeper[1] += int(net[quoted == 1].sum())
            flips += turns
    if here is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, inside, depth, base, last = None, 0, 0, 0, False
    # the bytes so far of the record that is open, none outside of records
    held: list[bytes] = []
    kind = _TAIL

    def rows(of_kind: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([here[0]] * n, pa.string()),
                pa.array([here[1]] * n, pa.int64()),
                pa.array([of_kind] * n, pa.int32()),
                texts,
            ],
            ["file", "block", "kind", "text"],
        )

    def held_text(end: bytes = b"") -> pa.Array:
        return pa.array([b"".join(held) + end], pa.binary()).view(pa.string())

    def left_open() -> pa.RecordBatch:
        if last:
            # the file breaks off: no comma stands there, and a string is closed
            held.pop()
            return rows(kind, held_text(b"" if held and held[-1].endswith(b'"') else b'"'))
        return rows(kind, held_text())

    for batch in batches:
        for split, run in _runs(batch):
            if split != here:
                if here is not None and depth > base:
                    yield left_open()
                if run.column(3)[0].as_py() is None:
                    raise ValueError(f"{split} was cut otherwise when it was summed up")
                here = split
                inside, depth, base, last = (run.column(i)[0].as_py() for i in (3, 4, 5, 6))
                held, kind = [], _HEAD if depth > base else _TAIL
            text, turns, brackets, quoted, net = _signs(run.column(2), inside)
            brackets, net = brackets[quoted == 0], net[quoted == 0]
            after = depth + np.cumsum(net)
            # records are what lies deeper than their array
            starts = brackets[(net == 1) & (after == base + 1)]
            ends = brackets[(net == -1) & (after == base)] + 1
            if depth > base:
                head = text[: ends[0]] if len(ends) else text
                held.append(head.tobytes())
                if len(ends):
                    yield rows(_HEAD if kind == _HEAD else _WHOLE, held_text())
                    held, kind, ends = [], _TAIL, ends[1:]
            if len(ends):
                yield rows(_WHOLE, _slices(text, starts[: len(ends)], ends))
            if len(starts) > len(ends):
                held = [text[starts[-1] :].tobytes()]
            depth += int(net.sum())
            if depth > base:
                held.append(b",")
            inside = (inside + turns) % 2
    if here is not None and depth > base:
        yield left_open()


def _slices(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of a text as strings; they do not overlap."""
    inner = np.zeros(len(text) + 1, np.int8)
    inner[starts] += 1
    inner[ends] -= 1
    kept = text[np.cumsum(inner[:-1], dtype=np.int8) == 1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
