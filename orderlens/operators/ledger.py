"""The stock ledger with its guards: what is not covered changes nothing.

A reserve needs that many available units, a release or commit that many
reserved ones. Whether a movement applies depends on all before it in its cell,
so a plain running sum is wrong wherever one is refused. A cell is walked in
order, one movement at a time, holding two numbers. A hot cell is cut into
slices that are walked side by side, each from the amounts it is thought to
start with, until every slice starts with what the one before it leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.plans.running import HOT_ROWS, Slices, measure_slices
from orderlens.plans.storage import pinned

CELL = ["warehouse_id", "sku"]
#: Parts over which the movements of a cell without stock are dealt.
SPREAD = 1024


def step(kind: str, quantity: int | None, reserved: int, available: int) -> tuple[int, int] | None:
    """The reserved and available units after a movement, None where it is refused."""
    if quantity is None or quantity < 1:
        return None
    if kind == "reserve" and available >= quantity:
        return reserved + quantity, available - quantity
    if kind == "release" and reserved >= quantity:
        return reserved - quantity, available + quantity
    if kind == "commit" and reserved >= quantity:
        return reserved - quantity, available
    return None


def _walk(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Sorted movements with ``applied``, or with ``ends`` what each slice changes.

    The first five columns are cell, slice, kind and quantity, the last two the
    amounts a slice starts with, null for a cell without stock.
    """
    at: tuple | None = None
    reserved = available = 0
    first = (0, 0)

    def left(rows: list[tuple]) -> pa.RecordBatch:
        names = ["warehouse_id", "sku", "slice", "dr", "da"]
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_LEFT)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, -2, -1)]
        applied, done = [], []
        for warehouse, sku, part, kind, quantity, r0, a0 in zip(*columns):
            if (warehouse, sku, part) != at:
                if ends and at is not None:
                    done.append((*at, reserved - first[0], available - first[1]))
                at, first, reserved, available = (warehouse, sku, part), (r0, a0), r0, a0
            after = None if r0 is None else step(kind, quantity, reserved, available)
            applied.append(after is not None)
            reserved, available = after or (reserved, available)
        if ends:
            yield left(done)
        else:
            kept = batch.select(batch.schema.names[:-2])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(applied)], [*kept.schema.names, "applied"]
            )
    if ends and at is not None:
        yield left([(*at, reserved - first[0], available - first[1])])


_LEFT = pa.schema(
    [("warehouse_id", pa.string()), ("sku", pa.string()), ("slice", pa.int64()), ("dr", pa.int64()), ("da", pa.int64())]
)


def _in_order(moves: DataFrame) -> DataFrame:
    others = [c for c in moves.columns if c not in (*CELL, "slice", "kind", "quantity", "r0", "a0")]
    return (
        moves.select(*CELL, "slice", "kind", "quantity", *others, "r0", "a0")
        .repartition(*CELL, "slice")
        .sortWithinPartitions(*CELL, "slice", "t", "seq", "kind", "quantity")
    )


def _starts(hot: DataFrame, opening: DataFrame) -> DataFrame:
    """``CELL, slice, r0, a0``: what each slice of the hot cells starts with.

    A slice starts with the opening amounts and what the slices before it change.
    The first guess of that has no refusals. Then every slice is walked from its
    guess, and those whose start moves by what others were found to change
    are walked again. A round makes at least the first wrong slice right, and
    every stretch of slices that change the same from either start at once: all
    of a cell that is sold out, all of one that refuses nothing. Each round is a
    small written table.
    """
    q = F.col("quantity").cast("bigint")
    change = hot.groupBy(*CELL, "slice").agg(
        F.sum(F.when(F.col("kind") == "reserve", q).otherwise(-q)).alias("dr"),
        F.sum(F.when(F.col("kind") == "reserve", -q).when(F.col("kind") == "release", q).otherwise(0)).alias("da"),
    )
    past = Window.partitionBy(*CELL).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def started(changes: DataFrame) -> DataFrame:
        def amount(start: str, moved: str) -> Column:
            return F.greatest(F.lit(0), F.col(start) + F.coalesce(F.sum(moved).over(past), F.lit(0)))

        available = amount("a0", "da")
        # units only leave a cell, so no more are reserved than the rest
        reserved = F.least(amount("r0", "dr"), F.greatest(F.lit(0), F.col("r0") + F.col("a0") - available))
        return pinned(
            changes.join(opening, CELL).select(*CELL, "slice", reserved.alias("r0"), available.alias("a0"))
        )

    starts = started(change)
    wrong, found = starts, None
    while True:
        walked = _in_order(hot.join(wrong, [*CELL, "slice"])).mapInArrow(
            lambda batches: _walk(batches, True),
            "warehouse_id string, sku string, slice bigint, dr bigint, da bigint",
        )
        if found is not None:
            walked = walked.unionByName(found.join(wrong, [*CELL, "slice"], "left_anti"))
        found = pinned(walked)
        proper = started(found)
        wrong = pinned(proper.join(starts, [*CELL, "slice", "r0", "a0"], "left_anti"))
        starts = proper
        if wrong.isEmpty():
            return starts


def guarded_moves(stock: DataFrame, movements: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every movement with ``applied``: whether its guard let it change the cell.

    ``movements``: ``warehouse_id, sku, kind, quantity, t, seq`` and any others,
    applied per cell by (t, seq), then kind and quantity. A cell without a stock
    row, an unknown kind and a quantity below one (or null) are refused. ``stock``
    has one row per cell.
    """
    columns = movements.columns
    opening = stock.select(
        *CELL,
        F.coalesce("reserved", F.lit(0)).cast("bigint").alias("r0"),
        F.coalesce("available", F.lit(0)).cast("bigint").alias("a0"),
    )
    every = movements.join(opening, CELL, "left")
    stocked = F.col("r0").isNotNull()
    # nothing depends on the order where there is no stock, so those rows are spread
    spread = F.pmod(F.xxhash64("t", "seq"), F.lit(SPREAD))
    slices: Slices = measure_slices(every.filter(stocked), CELL, "t", "seq", hot_rows)
    if slices.any:
        staged = pinned(slices.apply(every, "t", "seq").withColumnRenamed("_slice1", "slice"))
        hot = staged.filter(stocked & (F.col("slice") > 0)).drop("r0", "a0")
        cold = staged.filter(~stocked | (F.col("slice") == 0))
        known = cold.withColumn("slice", F.when(stocked, 0).otherwise(spread)).unionByName(
            hot.join(_starts(hot, opening), [*CELL, "slice"])
        )
    else:
        known = every.withColumn("slice", F.when(stocked, 0).otherwise(spread))
    ordered = _in_order(known)
    kept = [f for f in ordered.schema.fields if f.name not in ("r0", "a0")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    walked = ordered.mapInArrow(lambda batches: _walk(batches, False), f"{fields}, applied boolean")
    return walked.select(*columns, "applied")


def changes(moves: DataFrame) -> DataFrame:
    """Per cell what its applied movements add up to, and how many were refused."""
    q, kind = F.col("quantity").cast("bigint"), F.col("kind")

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("applied"), value)), F.lit(0)).alias(name)

    return moves.groupBy(*CELL).agg(
        total(F.when(kind == "commit", -q).otherwise(0), "d_on_hand"),
        total(F.when(kind == "reserve", q).otherwise(-q), "d_reserved"),
        total(F.when(kind == "reserve", -q).when(kind == "release", q).otherwise(0), "d_available"),
        total(F.lit(1), "d_version"),
        F.count(F.when(~F.col("applied"), 1)).alias("refused"),
    )


def replay_ledger(stock: DataFrame, movements: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stock cells after all movements that their guards let through.

    Returns ``warehouse_id, sku, on_hand, reserved, available, version,
    refused``; ``stock`` has all of these but the last.
    """
    change = changes(guarded_moves(stock, movements, hot_rows))
    numbers = ("on_hand", "reserved", "available", "version")
    return stock.join(change, CELL, "left").select(
        *CELL,
        *[(F.col(n) + F.coalesce(f"d_{n}", F.lit(0))).cast("bigint").alias(n) for n in numbers],
        F.coalesce("refused", F.lit(0)).cast("bigint").alias("refused"),
    )


def refused_movements(stock: DataFrame, movements: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The movements that changed nothing."""
    return guarded_moves(stock, movements, hot_rows).filter(~F.col("applied")).drop("applied")
