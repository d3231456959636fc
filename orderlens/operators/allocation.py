"""All-or-nothing allocation of multi-line orders in arrival order.

Picks are made against the stock at the start of the batch. After that every
order competes, in order, for the stock of its warehouse. Two running totals
decide most orders without any sequential work:

* if even granting everyone before it leaves enough, the order is admitted;
* if what is already granted before it leaves too little, it is refused.

The rounds repeat on what is open until little is left, and a short exact fold
per warehouse settles that rest. Every round settles at least the first open
order of each warehouse, so the loop ends, and no order is decided by a guess.
The first orders go first: stock only falls, so what they leave refuses most
later orders by one look at their lines, and the rounds follow the stock.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.inventory import INSUFFICIENT, NO_WAREHOUSE, place_lines
from orderlens.plans.running import HOT_ROWS, Slices, measure_slices, running_sums
from orderlens.plans.storage import stored

FOLD_LINES = 100_000
#: Lines of the first orders, settled before others are looked at; then four times as many.
FIRST_LINES = 400_000
_CELL = ["warehouse_id", "sku"]
_FOLDED = "warehouse_id string, order_id string, admitted boolean"


def _fold_open_orders(lines: pd.DataFrame) -> pd.DataFrame:
    """Settle the open orders of one warehouse one after another.

    ``left_before`` is what the orders settled earlier leave for the line.
    """
    lines = lines.dropna(subset=["t", "seq", "order_id"]).sort_values(["t", "seq", "sku"], kind="stable")
    taken: dict[str, int] = {}
    orders: dict[tuple, list[tuple]] = {}
    columns = ("t", "seq", "order_id", "warehouse_id", "sku", "quantity", "left_before")
    for t, seq, order_id, *want in zip(*(lines[c].tolist() for c in columns)):
        orders.setdefault((t, seq, order_id), []).append(want)
    rows = []
    for (_, _, order_id), wants in orders.items():
        fits = all(left - taken.get(sku, 0) >= q for _, sku, q, left in wants)
        if fits:
            for _, sku, q, _ in wants:
                taken[sku] = taken.get(sku, 0) + q
        rows.append((wants[0][0], order_id, fits))
    return pd.DataFrame(rows, columns=["warehouse_id", "order_id", "admitted"])


def _round(lines: DataFrame, slices: Slices) -> DataFrame:
    """One pass: settle what the two totals settle. ``admitted`` is null while open."""
    wanted = F.col("quantity").cast("bigint")
    may_take = F.when(F.coalesce(F.col("admitted"), F.lit(True)), wanted).otherwise(0)
    has_taken = F.when(F.coalesce(F.col("admitted"), F.lit(False)), wanted).otherwise(0)
    totals = running_sums(
        lines, _CELL, "t", "seq", {"_most": may_take, "_least": has_taken}, slices=slices
    )
    sure = F.col("_most") <= F.col("available")
    lost = F.col("_least") + F.when(F.col("admitted").isNull(), wanted).otherwise(0) > F.col(
        "available"
    )
    verdict = totals.filter(F.col("admitted").isNull()).groupBy("order_id").agg(
        F.min(sure.cast("int")).alias("_sure"), F.max(lost.cast("int")).alias("_lost")
    )
    settled = verdict.select(
        "order_id", F.when(F.col("_lost") == 1, False).when(F.col("_sure") == 1, True).alias("_now")
    )
    return lines.join(settled, "order_id", "left").withColumn(
        "admitted", F.coalesce("admitted", "_now")
    ).drop("_now")


def _settled(state: DataFrame, hot_rows: int, fold_lines: int) -> DataFrame:
    """``warehouse_id, order_id, admitted`` of orders that compete for ``available``."""
    # lines keep their place in every round, so hot cells are measured once
    slices = measure_slices(state, _CELL, "t", "seq", hot_rows)
    is_open = F.col("admitted").isNull()
    # refused lines take nothing from anybody and leave the rounds
    refused = []
    while state.filter(is_open).count() > fold_lines:
        after = stored(_round(state, slices), "allocate-round")
        refused.append(after.filter(~F.col("admitted")))
        state = after.filter(F.coalesce("admitted", F.lit(True)))

    taken = F.when(F.coalesce(F.col("admitted"), F.lit(False)), F.col("quantity")).otherwise(0)
    rest = running_sums(
        state, _CELL, "t", "seq", {"_taken": taken.cast("bigint")}, slices=slices
    ).filter(is_open)
    # at most ``fold_lines`` lines are open here, checked above
    folded = (
        rest.withColumn("left_before", F.col("available") - F.col("_taken"))
        .groupBy("warehouse_id")
        .applyInPandas(_fold_open_orders, _FOLDED)
    )
    done = reduce(DataFrame.unionByName, refused, state.filter(~is_open))
    return done.groupBy("warehouse_id", "order_id").agg(F.first("admitted").alias("admitted")).unionByName(folded)


def _left_for(later: DataFrame, now: DataFrame, done: DataFrame) -> DataFrame:
    """``later`` with what the orders of ``now`` that are admitted leave of its cells."""
    granted = done.filter("admitted").select("warehouse_id", "order_id")
    used = (
        now.join(granted, ["warehouse_id", "order_id"])
        .groupBy(*_CELL)
        .agg(F.sum("quantity").alias("_used"))
    )
    return later.join(used, _CELL, "left").withColumn(
        "available", F.col("available") - F.coalesce("_used", F.lit(0))
    ).drop("_used")


def allocate(
    lines: DataFrame,
    stock: DataFrame,
    *,
    hot_rows: int = HOT_ROWS,
    fold_lines: int = FOLD_LINES,
    first_lines: int = FIRST_LINES,
) -> DataFrame:
    """Allocate orders in ``(t, seq)`` order, all lines or none.

    ``lines``: ``order_id, seq, t, sku, quantity``, one per order and SKU.
    Lines of an order have its ``t, seq``. Returns ``order_id, warehouse_id,
    reserved, reason``. Never oversells.
    """
    placed = place_lines(lines, stock)
    nowhere = placed.filter(F.col("warehouse_id").isNull()).select("order_id").distinct()
    competing = (
        placed.filter(F.col("warehouse_id").isNotNull())
        .join(stock.select(*_CELL, "available"), _CELL, "left")
        .select(
            "order_id",
            F.col("seq").cast("bigint").alias("seq"),
            F.col("t").cast("bigint").alias("t"),
            *_CELL,
            F.col("quantity").cast("int").alias("quantity"),
            F.coalesce("available", F.lit(-1)).cast("bigint").alias("available"),
            F.lit(None).cast("boolean").alias("admitted"),
        )
    )
    waiting = stored(competing, "allocate-lines")
    total, share = waiting.count(), first_lines
    decided = []
    while True:
        # null times go first, as in every window here
        until = None
        if total > share:
            until = waiting.agg(F.percentile_approx("t", share / total, 10_000)).first()[0]
        is_now = F.col("t").isNull() | (F.col("t") <= F.lit(until))
        now = waiting if until is None else stored(waiting.filter(is_now), "allocate-now")
        done = _settled(now, hot_rows, fold_lines)
        if until is None:
            decided.append(done)
            break
        done = stored(done, "allocate-settled")
        decided.append(done)
        later = _left_for(waiting.filter(~is_now), now, done)
        # stock only falls: an order with a line above what is left is never granted
        lost = F.max(F.col("quantity") > F.col("available")).over(Window.partitionBy("order_id"))
        is_lost = F.col("order_id").isNotNull() & F.coalesce(lost, F.lit(False))
        later = stored(later.withColumn("_lost", is_lost), "allocate-later")
        decided.append(
            later.filter("_lost").groupBy("warehouse_id", "order_id").agg(F.lit(False).alias("admitted"))
        )
        waiting = stored(later.filter("not _lost").drop("_lost"), "allocate-lines")
        total, share = waiting.count(), share * 4
    decided = reduce(DataFrame.unionByName, decided)
    settled = decided.select(
        "order_id",
        "warehouse_id",
        F.col("admitted").alias("reserved"),
        F.when(~F.col("admitted"), INSUFFICIENT).alias("reason"),
    )
    return settled.unionByName(
        nowhere.select(
            "order_id",
            F.lit(None).cast("string").alias("warehouse_id"),
            F.lit(False).alias("reserved"),
            F.lit(NO_WAREHOUSE).alias("reason"),
        )
    )


def remaining_stock(stock: DataFrame, lines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stock after the reserved orders, to carry into the next batch."""
    used = (
        lines.join(outcomes.filter("reserved").select("order_id", "warehouse_id"), "order_id")
        .groupBy(*_CELL)
        .agg(F.sum("quantity").alias("_used"))
    )
    return stock.join(used, _CELL, "left").withColumn(
        "available", F.col("available") - F.coalesce("_used", F.lit(0))
    ).drop("_used")
