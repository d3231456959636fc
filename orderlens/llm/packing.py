"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import code_of, word_count, written

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that one packing task takes.
PACK_ROWS = 20_000
#: Words at which attention over a sequence costs as much as all else.
ATTENTION = 16_384
#: What every sequence costs besides, in words: launches, padding, bookkeeping.
OVERHEAD = 256


def sequence_cost(length: int) -> float:
    """What a sequence costs: an overhead, its words, and attention between them."""
    return OVERHEAD + length * (1 + length / ATTENTION)


def _filling(room: int, counts: dict[int, int], present: int) -> int:
    """The words that the largest fitting sizes left put into ``room``.

    ``counts`` has how many of each size are left, ``present`` their bits.
    """
    filled, taken = 0, {}
    while room:
        fits = present & ((1 << (room + 1)) - 1)
        if not fits:
            return filled
        size = fits.bit_length() - 1
        left = counts[size] - taken.get(size, 0)
        n = min(left, room // size)
        if n == left:
            present ^= 1 << size
        taken[size] = taken.get(size, 0) + n
        filled += n * size
        room -= n * size
    return filled


def cheapest_length(
    size: int, lengths: Sequence[int], counts: dict[int, int], present: int
) -> int:
    """The length to open for a piece: of least cost per word it can be filled with.

    Each length is filled with the pieces that are left, largest first, and
    counted at the length it then shrinks to. A long sequence wins where what is
    left fills it, as it shares the overhead; a short one where it does not, or
    where attention costs more. The longer one on a tie.
    """
    best, price = 0, float("inf")
    for length in lengths:
        if length >= size:
            words = size + _filling(length - size, counts, present)
            final = next(c for c in lengths if c >= words)
            cost = sequence_cost(final) / words
            if cost <= price:
                best, price = length, cost
    return best


def best_fit(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS
) -> tuple[list[int], list[int], list[int]]:
    """Pack sizes, given in falling order, none above the longest length.

    Each goes to the open bin that it leaves fullest. Where none has room, the
    length of ``cheapest_length`` is opened. In the end each bin shrinks to the
    shortest length that holds its contents. Returns the bin and the offset of
    each size, and each bin's length.
    """
    lengths = sorted(lengths)
    bin_of, offset, room, used = [], [], [], []
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit i is set if some bin has room for i
    counts = Counter(sizes)
    present = sum(1 << size for size in counts)
    for size in sizes:
        counts[size] -= 1
        if not counts[size]:
            present ^= 1 << size
        fits = rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                rooms ^= 1 << left
        else:
            left = cheapest_length(size, lengths, counts, present)
            chosen = len(room)
            room.append(left)
            used.append(0)
        bin_of.append(chosen)
        offset.append(used[chosen])
        used[chosen] += size
        room[chosen] = left = left - size
        if left:
            open_bins.setdefault(left, []).append(chosen)
            rooms |= 1 << left
    final = [next(c for c in lengths if c >= u) for u in used]
    return bin_of, offset, final


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """Documents cut into pieces of at most ``longest`` words: ``doc_id, code,
    piece, start, n_words``. A document without words is one empty piece."""
    last = F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0))
    return (
        docs.select("doc_id", code_of("doc_id", "text").alias("code"), word_count().alias("size"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("start", F.col("piece") * longest)
        .withColumn("n_words", F.least(F.col("size") - F.col("start"), F.lit(longest)))
        .drop("size")
    )


def pack(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, pack_rows: int = PACK_ROWS
) -> DataFrame:
    """Place every document in sequences of the permitted lengths.

    Documents longer than the longest length are cut into pieces of it. Pieces
    are dealt by hash over tasks of about ``pack_rows`` pieces; each packs its
    own, in falling order of size, then code, so reruns agree. Only numbers
    are moved, never texts. Documents without words (null, empty) get one row
    without a bin. Repeated rows are packed as often as they occur; an empty
    table gives no rows.

    Returns ``doc_id, piece, start, n_words, bin, bin_offset, bin_length,
    bin_used``; ``start`` counts words in the document, ``bin_offset`` in the bin.
    """
    every = written(pieces(docs, max(lengths)), "pieces")
    tasks = max(1, -(-every.count() // pack_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    permitted = tuple(lengths)

    def packed(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [g for g in groups if len(g)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for task, part in rows.groupby("task", sort=True):
            part = part.sort_values(
                ["n_words", "code", "piece"], ascending=[False, True, True], kind="stable"
            ).reset_index(drop=True)
            bins, offsets, sizes = best_fit(part["n_words"].tolist(), permitted)
            used = part["n_words"].groupby(bins).sum()
            yield part.assign(
                bin=[f"{task}-{b}" for b in bins],
                bin_offset=offsets,
                bin_length=[sizes[b] for b in bins],
                bin_used=used.loc[bins].to_numpy(),
            ).drop(columns=["task", "code"])

    columns = "piece bigint, start bigint, n_words bigint"
    placed = (
        every.filter("n_words > 0")
        .withColumn("task", F.pmod(F.xxhash64("code", "piece"), F.lit(tasks)))
        .repartition(tasks, "task")
        .mapInPandas(
            packed,
            f"doc_id {kind}, {columns}, bin string, bin_offset bigint, bin_length bigint, "
            "bin_used bigint",
        )
    )
    empty = every.filter("n_words = 0").select(
        "doc_id",
        "piece",
        "start",
        "n_words",
        F.lit(None).cast("string").alias("bin"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("bin_offset", "bin_length", "bin_used")],
    )
    return placed.unionByName(empty)
