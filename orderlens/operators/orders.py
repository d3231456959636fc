"""Orders: the rows an event becomes, their current state, and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEARING_STATUSES = ("rejected", "cancelled")


def fan_out(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order rows, line rows and audit rows of accepted orders.

    ``orders.items`` is the event's array of lines.
    """
    head = orders.select(
        "order_id",
        "customer_id",
        "total_cents",
        "idempotency_key",
        F.lit("accepted").alias("status"),
        F.col("received_at").alias("created_at"),
    )
    lines = orders.select("order_id", F.posexplode("items").alias("line_id", "item")).select(
        "order_id", "line_id", F.col("item.sku").alias("sku"), F.col("item.quantity").alias("quantity")
    )
    audit = orders.select(
        F.lit("order").alias("entity"),
        F.col("order_id").alias("entity_id"),
        F.lit("accepted").alias("action"),
        F.lit("api").alias("actor"),
        F.col("received_at").alias("created_at"),
    )
    return head, lines, audit


def current_state(updates: DataFrame, position: list[str]) -> DataFrame:
    """Fold status updates per order: the last status wins, a score and band
    stay until replaced, and a hold reason stays until replaced or cleared.

    Each part is the latest of its own kind, so all come from one partial
    aggregate without sorting an order's history.
    """

    def latest(value: Column, when: Column | None = None) -> Column:
        entry = F.struct(*position, value.alias("_v"))
        return F.max(entry if when is None else F.when(when, entry)).getField("_v")

    status = F.col("status")
    clears = status.isin(*CLEARING_STATUSES)
    reason = F.when(~clears, F.col("hold_reason"))
    return updates.groupBy("order_id").agg(
        latest(status).alias("status"),
        latest(reason, clears | F.col("hold_reason").isNotNull()).alias("hold_reason"),
        latest(F.col("score"), F.col("score").isNotNull()).alias("score"),
        latest(F.col("band"), F.col("band").isNotNull()).alias("band"),
    )


def count_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def needing_stock(orders: DataFrame, reservations: DataFrame, limit: int | None = None) -> DataFrame:
    """Scored orders without a held reservation, oldest first when limited."""
    held = reservations.filter(F.col("state") == "held").select("order_id")
    out = orders.filter(F.col("status") == "scored").join(held, "order_id", "left_anti")
    return out if limit is None else out.orderBy("received_at", "order_id").limit(limit)


def detail(orders: DataFrame, lines: DataFrame, latest_scores: DataFrame) -> DataFrame:
    """Each order with its ordered lines and its newest score."""
    grouped = lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("sku", "quantity"))).alias("lines")
    )
    return (
        orders.join(grouped, "order_id", "left")
        .join(latest_scores, "order_id", "left")
        .withColumn(
            "lines",
            F.coalesce("lines", F.array().cast("array<struct<sku:string,quantity:int>>")),
        )
    )
