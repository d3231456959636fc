"""Allocation in which every order picks its warehouse when its turn comes.

A pick looks at the stock that all earlier grants have left, so an order depends
on every earlier one that shares a SKU with it, and on nothing else. SKUs ordered
together form a graph; its components have no stock in common and are allocated
side by side. Inside a component the orders that may be granted go one after
another, in slices of a bounded number of lines: one round settles the same slice
of all components and hands the remaining stock to the next.

Stock only falls. An order with a line that no warehouse covers any more is never
granted and takes nothing, so it leaves the rounds: what is walked in turn follows
the stock, not the number of orders. Its pick is looked up afterwards, side by
side, in what was the fullest warehouse of each SKU at its turn. As a grant is
seen by the very next order, it makes no difference where a table, a slice or a
micro-batch is cut.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.allocation import remaining_stock
from orderlens.operators.inventory import INSUFFICIENT, NO_WAREHOUSE, best_warehouse_by_sku
from orderlens.plans.running import HOT_ROWS, SLICES_PER_QUOTA, measure_slices, running_sums
from orderlens.plans.storage import fresh_path, pinned, stored

#: Lines of one component that one task settles in a round.
SLICE_LINES = 200_000
_CELL = ["warehouse_id", "sku"]
_OUTCOME = "order_id string, warehouse_id string, reserved boolean, reason string"
#: An order's outcome, or (without an order) the fullest warehouse of a SKU after a grant.
_SETTLED = f"{_OUTCOME}, sku string, t bigint, seq bigint, most bigint"
_LINE = "order_id string, seq bigint, t bigint, sku string, quantity bigint, component string, slice int"


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the graph with edges ``a, b``: the least node reached.

    Labels travel along edges and then jump to the label of their label, so long
    chains take few rounds. A node alone has an edge to itself.
    """
    both = pinned(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(edges.select("b", "a"))
        .distinct()
    )
    labels = pinned(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("component")))
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("_near"))
        )
        near = labels.join(around, "node").select(
            "node", F.least("component", "_near").alias("component")
        )
        far = near.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        after = pinned(
            near.join(far, "component").select("node", F.least("component", "_far").alias("component"))
        )
        if after.join(labels, ["node", "component"], "left_anti").isEmpty():
            return labels
        labels = after


def _settle(lines: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """The orders of one component and slice, one after another.

    Stock only falls, so a heap per SKU with its fullest warehouse on top is
    corrected when it is looked at.
    """
    left = {(w, s): a for w, s, a in zip(cells["warehouse_id"], cells["sku"], cells["available"])}
    offers: dict[str, list[tuple[int, str]]] = {}
    for (warehouse, sku), available in left.items():
        offers.setdefault(sku, []).append((-available, warehouse))
    for heap in offers.values():
        heapq.heapify(heap)

    def best(sku: str, quantity: int) -> tuple[int, str] | None:
        heap = offers.get(sku)
        if not heap or quantity < 1:
            return None
        while -heap[0][0] != left[heap[0][1], sku]:
            heapq.heapreplace(heap, (-left[heap[0][1], sku], heap[0][1]))
        minus, warehouse = heap[0]
        return (minus + quantity, warehouse) if -minus >= quantity else None

    rows = []

    def refused(order_id: str, at: str | None, reason: str) -> None:
        rows.append((order_id, at, False, reason, None, None, None, None))

    ordered = lines.sort_values(["t", "seq", "order_id", "sku"], kind="stable")
    columns = [ordered[c].tolist() for c in ("order_id", "t", "seq", "sku", "quantity")]
    # an order's lines have one time, so they stand together
    for (order_id, t, seq), own in groupby(zip(*columns), key=lambda line: line[:3]):
        wants = [line[3:] for line in own]
        found = [offer for offer in (best(*want) for want in wants) if offer]
        if not found:
            refused(order_id, None, NO_WAREHOUSE)
            continue
        at = min(found)[1]
        if not all(q >= 1 and left.get((at, sku), -1) >= q for sku, q in wants):
            refused(order_id, at, INSUFFICIENT)
            continue
        rows.append((order_id, at, True, None, None, None, None, None))
        for sku, q in wants:
            left[at, sku] -= q
        for sku, _ in wants:
            best(sku, 1)
            minus, fullest = offers[sku][0]
            rows.append((None, fullest, None, None, sku, t, seq, -minus))
    names = ["order_id", "warehouse_id", "reserved", "reason", "sku", "t", "seq", "most"]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"t": "Int64", "seq": "Int64", "most": "Int64", "reserved": "boolean"})


def _placed(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with ``component``, their order's ``t, seq`` and number of lines ``n``;
    and the component of each SKU."""
    own = Window.partitionBy("order_id")
    last = F.lit((1 << 63) - 1).cast("bigint")
    rows = stored(
        wanted.filter(F.col("order_id").isNotNull()).select(
            "order_id",
            F.coalesce(F.min("t").over(own), last).alias("t"),
            F.coalesce(F.min("seq").over(own), last).alias("seq"),
            "sku",
            "quantity",
            F.count(F.lit(1)).over(own).alias("n"),
            F.min("sku").over(own).alias("_first"),
        ),
        "turns-lines",
    )
    edges = rows.filter(F.col("sku").isNotNull()).select(F.col("_first").alias("a"), F.col("sku").alias("b"))
    found = stored(components(edges.distinct()).withColumnRenamed("node", "sku"), "turns-components")
    return rows.join(found.withColumnRenamed("sku", "_first"), "_first").drop("_first"), found


def _still_covered(lines: DataFrame, left: DataFrame) -> DataFrame:
    """The lines of the orders of which every line is covered somewhere."""
    most = left.groupBy("sku").agg(F.max("available").alias("_most"))
    covered = lines.join(most, "sku").filter((F.col("quantity") >= 1) & (F.col("_most") >= F.col("quantity")))
    count = F.count(F.lit(1)).over(Window.partitionBy("order_id"))
    return covered.withColumn("_covered", count).filter(F.col("_covered") == F.col("n")).drop("_most", "_covered")


def _picks(lines: DataFrame, stock: DataFrame, left: DataFrame, changes: DataFrame, hot_rows: int) -> DataFrame:
    """The outcomes of orders that are refused: where each picks at its turn.

    ``changes``: the fullest warehouse of a SKU after each grant. Orders after the
    last grant of their component look at what is ``left``. The others count the
    changes of a line's SKU before it.
    """
    at = F.struct("t", "seq")
    ends = stored(changes.groupBy("component").agg(F.max(at).alias("_end")), "turns-ends")
    marked = lines.join(ends, "component", "left")
    is_late = F.col("_end").isNull() | (at > F.col("_end"))
    wants = ["order_id", "sku", "quantity"]
    late = marked.filter(is_late).select(*wants).join(best_warehouse_by_sku(left), "sku", "left")

    zero = F.lit(0).cast("bigint")
    numbers = {"version": F.col("change")}
    steps = changes.select("sku", "t", "seq", "most", F.col("warehouse_id").alias("at"), F.lit(1).cast("bigint").alias("change"))
    versions = stored(
        running_sums(steps, ["sku"], "t", "seq", numbers, hot_rows=hot_rows)
        .select("sku", "version", "most", "at")
        .unionByName(best_warehouse_by_sku(stock).withColumn("version", zero)),
        "turns-versions",
    )
    early = marked.filter(~is_late).select(*wants, "t", "seq", zero.alias("change"))
    both = early.unionByName(steps.drop("most", "at"), allowMissingColumns=True)
    seen = running_sums(both, ["sku"], "t", "seq", numbers, hot_rows=hot_rows).filter(F.col("change") == 0)
    early = seen.select(*wants, "version").join(versions, ["sku", "version"], "left").drop("version")

    headroom = F.col("most") - F.col("quantity")
    offer = F.when(
        (F.col("quantity") >= 1) & (headroom >= 0),
        F.struct((-headroom).alias("_minus"), F.col("at").alias("warehouse_id")),
    )
    return (
        late.unionByName(early)
        .groupBy("order_id")
        .agg(F.min(offer)["warehouse_id"].alias("warehouse_id"))
        .select(
            "order_id",
            "warehouse_id",
            F.lit(False).alias("reserved"),
            F.when(F.col("warehouse_id").isNull(), NO_WAREHOUSE).otherwise(INSUFFICIENT).alias("reason"),
        )
    )


def allocate_in_turn(
    lines: DataFrame,
    stock: DataFrame,
    *,
    slice_lines: int = SLICE_LINES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Allocate orders in ``(t, seq)`` order, all lines or none, with live picks.

    ``lines``: ``order_id, seq, t, sku, quantity``, one per order and SKU; ``seq``
    differs between orders. ``stock``: one row per cell. An order goes to the
    warehouse with the most headroom on one of its lines at its turn, the smaller
    id on a tie, and is refused where that lacks another line. A line without a
    SKU or with a quantity below one (or null) is covered nowhere. Returns
    ``order_id, warehouse_id, reserved, reason``. Never oversells.
    """
    spark = lines.sparkSession
    wanted = lines.select(
        "order_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("t").cast("bigint").alias("t"),
        "sku",
        F.coalesce(F.col("quantity").cast("bigint"), F.lit(0)).alias("quantity"),
    )
    base, of_sku = _placed(wanted)
    cells = stock.filter("available IS NOT NULL").select(*_CELL, F.col("available").cast("bigint").alias("available"))
    opening = left = stored(cells, "turns-stock")
    results = fresh_path(spark, "turns-settled")
    turns = fresh_path(spark, "turns-walked")
    waiting, number, rounds = base, 0, 1
    while True:
        # every walk is of twice as many rounds as the one before, so that few of
        # them read what waits
        cuts = measure_slices(waiting, ["component"], "t", "seq", slice_lines)
        if cuts.any:
            until = cuts.levels[0].select("component", F.get("_cuts", F.lit(rounds * SLICES_PER_QUOTA - 1)).alias("_until"))
            # a row per component with more lines than a slice
            marked = waiting.join(F.broadcast(until), "component", "left")
            is_now = F.col("_until").isNull() | (F.struct(F.col("t").alias("p"), F.col("seq").alias("t")) < F.col("_until"))
            now, later = marked.filter(is_now).drop("_until"), marked.filter(~is_now).drop("_until")
            cut = F.floor((F.greatest(F.lit(1), F.col("_slice1")) - 1) / SLICES_PER_QUOTA)
            now = cuts.apply(now, "t", "seq").withColumn("slice", (cut + number).cast("int")).drop("_slice1")
        else:
            now, later = waiting.withColumn("slice", F.lit(number)), None
        walk = f"{turns}/from={number}"
        now.drop("n").repartition("component", "slice").write.partitionBy("slice").parquet(walk)
        every = spark.read.schema(_LINE).parquet(walk)
        last = every.agg(F.max("slice")).first()[0]
        while last is not None and number <= last:
            turn = every.filter(F.col("slice") == number)
            needed = turn.select(F.col("component").alias("of"), "sku").distinct()
            settled = f"{results}/slice={number}"
            turn.drop("slice").groupBy("component").cogroup(left.join(needed, "sku").groupBy("of")).applyInPandas(
                _settle, _SETTLED
            ).write.mode("overwrite").parquet(settled)
            done = spark.read.schema(_SETTLED).parquet(settled).filter(F.col("order_id").isNotNull())
            left = stored(remaining_stock(left, turn, done), "turns-stock")
            number += 1
        if later is None:
            break
        waiting = stored(_still_covered(later, left), "turns-waiting")
        if waiting.isEmpty():
            break
        rounds *= 2
    nowhere = (
        wanted.groupBy("order_id")
        .agg(F.count("sku").alias("_skus"))
        .filter(F.col("_skus") == 0)
        .select(
            "order_id",
            F.lit(None).cast("string").alias("warehouse_id"),
            F.lit(False).alias("reserved"),
            F.lit(NO_WAREHOUSE).alias("reason"),
        )
    )
    if number == 0:
        return nowhere
    found = spark.read.schema(_SETTLED).parquet(*[f"{results}/slice={n}" for n in range(number)])
    settled = found.filter(F.col("order_id").isNotNull()).select("order_id", "warehouse_id", "reserved", "reason")
    if later is None and rounds == 1:
        return settled.unionByName(nowhere)
    changes = found.filter(F.col("order_id").isNull()).join(of_sku, "sku")
    refused = base.join(stored(settled.select("order_id"), "turns-done"), "order_id", "left_anti")
    return settled.unionByName(_picks(refused, opening, left, changes, hot_rows)).unionByName(nowhere)
