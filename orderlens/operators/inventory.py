"""Stock: where an order can be served, who gets it, and what a hold becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.clock import add_seconds
from orderlens.operators.ledger import guarded_moves
from orderlens.plans.running import HOT_ROWS, first_per_key, row_numbers
from orderlens.plans.single import one_row

# Why an order gets no stock.
NO_WAREHOUSE = "no warehouse holds these items"
INSUFFICIENT = "insufficient stock"


def best_warehouse_by_sku(stock: DataFrame) -> DataFrame:
    """Per SKU the fullest warehouse, the smaller id on a tie.

    Headroom is available minus quantity, so for any quantity the fullest
    warehouse is the best one. One row per SKU instead of one per warehouse.
    """
    return (
        stock.groupBy("sku")
        .agg(F.min(F.struct((-F.col("available")).alias("_minus"), "warehouse_id")).alias("_b"))
        .select("sku", (-F.col("_b._minus")).alias("most"), F.col("_b.warehouse_id").alias("at"))
    )


def place_lines(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Add to every line its order's pick, ``warehouse_id``.

    The pick has the most headroom on any single line of the order, and is
    null where no warehouse covers any line. It looks at one line only, so it
    may lack another line of the same order. A window over the order's merged
    lines, at most one per SKU, so the lines are read and shuffled once.
    """
    offers = lines.join(best_warehouse_by_sku(stock), "sku", "left").withColumn(
        "_headroom", F.col("most") - F.col("quantity")
    )
    best = F.min(
        F.when(
            F.col("_headroom") >= 0,
            F.struct((-F.col("_headroom")).alias("_minus"), F.col("at").alias("warehouse_id")),
        )
    ).over(Window.partitionBy("order_id"))
    return offers.withColumn("warehouse_id", best["warehouse_id"]).drop("most", "at", "_headroom")


def pick_warehouse(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Per order its pick, ``order_id, warehouse_id``."""
    return (
        place_lines(lines, stock)
        .groupBy("order_id")
        .agg(F.min("warehouse_id").alias("warehouse_id"))
    )


def reserve_from_snapshot(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Each order against the given stock, as if it were the only one.

    One row per order: ``warehouse_id, reserved, reason, short_lines`` and
    ``shortfalls``, the lines that the warehouse does not cover; all lines where
    there is no warehouse.
    """
    placed = place_lines(lines, stock).join(
        stock.select("warehouse_id", "sku", "available"), ["warehouse_id", "sku"], "left"
    )
    short = F.coalesce(F.col("available"), F.lit(-1)) < F.col("quantity")
    return (
        placed.groupBy("order_id", "warehouse_id")
        .agg(
            F.sum(short.cast("bigint")).alias("short_lines"),
            # at most a line per SKU
            F.array_sort(F.collect_list(F.when(short, F.struct("sku", "quantity")))).alias("shortfalls"),
        )
        .withColumn("reserved", F.col("warehouse_id").isNotNull() & (F.col("short_lines") == 0))
        .withColumn(
            "reason",
            F.when(F.col("warehouse_id").isNull(), NO_WAREHOUSE).when(
                F.col("short_lines") > 0, INSUFFICIENT
            ),
        )
    )


def refusal_attribution(lines: DataFrame, outcomes: DataFrame, stock: DataFrame) -> DataFrame:
    """Which warehouses a refusal counts against.

    A refusal by a warehouse is its own. One by nobody counts for every
    warehouse that stocks the order's first SKU in sort order, or for "none".
    """
    refused = outcomes.filter(F.col("reason").isNotNull())
    nobody = refused.filter(F.col("warehouse_id").isNull()).select("order_id")
    first_sku = (
        lines.join(nobody, "order_id", "left_semi").groupBy("order_id").agg(F.min("sku").alias("sku"))
    )
    holders = stock.select("sku", "warehouse_id").distinct()
    spread = first_sku.join(holders, "sku", "left").select(
        "order_id", F.coalesce("warehouse_id", F.lit("none")).alias("warehouse_id")
    )
    own = refused.filter(F.col("warehouse_id").isNotNull()).select("order_id", "warehouse_id")
    return own.unionByName(spread)


def reserve_in_order(
    requests: DataFrame, stock: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Admit single-SKU requests in arrival order while stock covers them.

    The ledger with reserves only: a refused request takes nothing. A cell is
    walked with one number in memory, and a hot one in slices side by side; as
    stock only falls, later slices soon start alike. ``requests``:
    ``warehouse_id, sku, seq, quantity, t``; a quantity below one is refused.
    """
    cells = stock.select("warehouse_id", "sku", "available", F.lit(0).alias("reserved"))
    asked = requests.select("warehouse_id", "sku", "seq", "quantity", "t", F.lit("reserve").alias("kind"))
    return guarded_moves(cells, asked, hot_rows).select(
        "warehouse_id",
        "sku",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("applied").alias("admitted"),
    )


def admit_units(requests: DataFrame, stock: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same for requests of one unit each: the first ``available`` get one."""
    cells = requests.join(
        stock.select("warehouse_id", "sku", "available"), ["warehouse_id", "sku"], "left"
    )
    turn = row_numbers(cells, ["warehouse_id", "sku"], "t", "seq", "turn", hot_rows)
    return turn.withColumn(
        "admitted", F.col("turn") <= F.coalesce(F.col("available"), F.lit(0))
    )


def create_reservations(
    granted: DataFrame, lines: DataFrame, ttl_seconds: int = schemas.RESERVATION_TTL_SECONDS
) -> DataFrame:
    """One hold per order and warehouse with its lines on it.

    ``granted``: ``order_id, warehouse_id, created_at``. Lines are merged per
    SKU, so the array is as long as the order has SKUs.
    """
    one = granted.groupBy("order_id", "warehouse_id").agg(F.min("created_at").alias("created_at"))
    snapshot = lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("sku", "quantity"))).alias("lines")
    )
    return one.join(snapshot, "order_id", "left").select(
        F.concat(F.lit("R-"), F.col("order_id")).alias("reservation_id"),
        "order_id",
        "warehouse_id",
        F.lit("held").alias("state"),
        "created_at",
        add_seconds(F.col("created_at"), ttl_seconds).alias("expires_at"),
        "lines",
    )


def reservation_lines(reservations: DataFrame, order_lines: DataFrame) -> DataFrame:
    """The lines of each hold: its own snapshot, else the order's lines."""
    has_own = F.col("lines").isNotNull() & (F.size("lines") > 0)
    own = reservations.filter(has_own).select("reservation_id", F.inline("lines"))
    bare = reservations.filter(~F.coalesce(has_own, F.lit(False)))
    looked_up = bare.select("reservation_id", "order_id").join(order_lines, "order_id")
    return own.unionByName(looked_up.select("reservation_id", "sku", "quantity"))


def settle_reservations(reservations: DataFrame, transitions: DataFrame) -> DataFrame:
    """The first commit or release of a hold decides, later ones do nothing.

    Equal times are decided by arrival where ``transitions`` has ``seq``.
    """
    arrival = [c for c in ("t", "seq", "transition") if c in transitions.columns]
    first = transitions.groupBy("reservation_id").agg(
        F.min(F.struct(*arrival)).alias("_first"),
        (F.count(F.lit(1)) - 1).alias("noops"),
    )
    move = F.col("_first.transition")
    return reservations.join(first, "reservation_id", "left").select(
        "reservation_id",
        "order_id",
        "warehouse_id",
        F.when(move == "commit", "committed")
        .when(move == "release", "released")
        .otherwise("held")
        .alias("state"),
        F.col("_first.t").alias("settled_t"),
        F.coalesce("noops", F.lit(0)).cast("bigint").alias("noops"),
    )


def expired(reservations: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Holds past their time; with ``limit`` only so many, the oldest first."""
    late = reservations.filter((F.col("state") == "held") & (F.col("expires_at") < now))
    if limit is None:
        return late
    return late.orderBy("expires_at", "reservation_id").limit(limit)


def sweep_effects(
    reservations: DataFrame, order_lines: DataFrame, now: Column, limit: int | None = None
) -> DataFrame:
    """Units each cell gets back when the expired holds are released."""
    swept = expired(reservations, now, limit)
    lines = reservation_lines(swept, order_lines).join(
        swept.select("reservation_id", "warehouse_id"), "reservation_id"
    )
    return lines.groupBy("warehouse_id", "sku").agg(
        F.sum("quantity").alias("released_units"), F.count(F.lit(1)).alias("released_lines")
    )


def active_count(reservations: DataFrame) -> DataFrame:
    return reservations.filter(F.col("state") == "held").agg(F.count(F.lit(1)).alias("active"))


def stock_by_sku(stock: DataFrame) -> DataFrame:
    return stock.groupBy("sku").agg(
        F.coalesce(F.sum("available"), F.lit(0)).alias("total_available"),
        F.count(F.lit(1)).alias("warehouses"),
    )


def total_available(stock: DataFrame, sku: str) -> DataFrame:
    return stock.filter(F.col("sku") == sku).agg(
        F.coalesce(F.sum("available"), F.lit(0)).alias("available")
    )


def inventory_events(settled: DataFrame, outcomes: DataFrame, lines: DataFrame) -> DataFrame:
    """The four kinds of inventory event as ``event_type, order_id, payload``.

    ``settled`` are holds with a final state and ``expires_at``; ``outcomes``
    are orders with a ``reason`` where refused and their ``shortfalls``, which a
    shortfall event lists.
    """
    per_order = lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("sku", "quantity"))).alias("lines")
    )
    base = ["order_id", "warehouse_id", "reservation_id"]
    held = settled.join(per_order, "order_id", "left").select(
        F.lit("inventory.reserved").alias("event_type"),
        "order_id",
        F.to_json(F.struct("order_id", "warehouse_id", "lines", "reservation_id", "expires_at")).alias(
            "payload"
        ),
    )
    done = settled.filter(F.col("state").isin("committed", "released")).select(
        F.concat(F.lit("inventory."), F.col("state")).alias("event_type"),
        "order_id",
        F.when(
            F.col("state") == "released",
            F.to_json(F.struct(*base, F.lit("rejected").alias("reason"))),
        )
        .otherwise(F.to_json(F.struct(*base)))
        .alias("payload"),
    )
    refused = outcomes.filter(F.col("reason").isNotNull())
    short = refused.select(
        F.lit("inventory.shortfall").alias("event_type"),
        "order_id",
        F.to_json(
            F.struct(
                "order_id",
                F.coalesce("warehouse_id", F.lit("none")).alias("warehouse_id"),
                F.col("shortfalls").alias("requested"),
                "reason",
            )
        ).alias("payload"),
    )
    return held.unionByName(done).unionByName(short)


def missing_reservations(
    reserved_events: DataFrame,
    reservations: DataFrame,
    ttl_seconds: int = schemas.RESERVATION_TTL_SECONDS,
) -> DataFrame:
    """Holds to re-create: a reserved event whose reservation row is gone.

    The lines come from the event, so the later release has units to return.
    """
    gone = reserved_events.join(reservations, ["order_id", "warehouse_id"], "left_anti")
    return first_per_key(gone, ["order_id", "warehouse_id"], [F.col("occurred_at")]).select(
        "order_id",
        "warehouse_id",
        F.lit("held").alias("state"),
        add_seconds(F.col("occurred_at"), ttl_seconds).alias("expires_at"),
        "lines",
    )


def shortfall_rate(outcomes: DataFrame) -> DataFrame:
    """Refusals per warehouse and their share of its reservation attempts."""
    refused = F.count(F.when(F.col("reason").isNotNull(), 1))
    return (
        outcomes.groupBy(F.coalesce("warehouse_id", F.lit("none")).alias("warehouse_id"))
        .agg(F.count(F.lit(1)).alias("attempts"), refused.alias("refused"))
        .withColumn("refusal_ratio", F.col("refused") / F.col("attempts"))
    )


def outcome_tallies(settled: DataFrame, outcomes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: what the inventory worker did."""

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    holds = settled.agg(
        count(F.col("state") == "released").alias("released"),
        count(F.col("state") == "committed").alias("committed"),
        F.coalesce(F.sum("noops"), F.lit(0)).alias("noops"),
    )
    tries = outcomes.agg(
        count(F.col("reserved")).alias("reserved"),
        count(~F.col("reserved")).alias("shortfalls"),
    )
    copies = deliveries.groupBy("event_id").agg((F.count(F.lit(1)) - 1).alias("_extra"))
    twice = copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicates"))
    return one_row([holds, tries, twice])
