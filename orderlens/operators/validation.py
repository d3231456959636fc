"""Order checks at the boundary, as columns and small aggregates.

Lines are checked relationally, so an order with very many lines is combined
map-side instead of being gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of an order request.
MAX_SKU_LENGTH = 64
MAX_QUANTITY = 9999
MAX_CENTS = 100_000_000
MAX_ITEMS = 200
MAX_NOTE = 500
BIN_LENGTH = 6
LAST4_LENGTH = 4
COUNTRY_LENGTH = 2
DEFAULT_IP_COUNTRY = "ZZ"
PUBLIC_HOLD_TEXT = "order held for review"
UNDISCLOSED_STATUSES = ("approved", "rejected", "cancelled")


def _outside(value: Column, low: int, high: int) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(True))


def line_faults(lines: DataFrame) -> DataFrame:
    """Per order: how many lines, and which line rules any of them breaks."""

    def any_line(condition: Column) -> Column:
        return F.max(condition.cast("int")) == 1

    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        any_line(_outside(F.length("sku"), 1, MAX_SKU_LENGTH)).alias("bad_sku"),
        any_line(_outside(F.col("quantity"), 1, MAX_QUANTITY)).alias("bad_quantity"),
        any_line(_outside(F.col("unit_price_cents"), 0, MAX_CENTS)).alias("bad_price"),
    )


def validate_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``failed_rules``; an empty array means the order passes.

    A missing IP country is given the default, a blank one is checked.
    """
    checked = orders.join(line_faults(lines), "order_id", "left")

    def length(name: str, low: int, high: int) -> Column:
        return _outside(F.length(name), low, high)

    ip = F.coalesce(F.col("ip_country"), F.lit(DEFAULT_IP_COUNTRY))
    rules = {
        "customer_id": length("customer_id", 1, 64),
        "items": _outside(F.coalesce(F.col("item_count"), F.lit(0)), 1, MAX_ITEMS),
        "sku": F.coalesce(F.col("bad_sku"), F.lit(False)),
        "quantity": F.coalesce(F.col("bad_quantity"), F.lit(False)),
        "unit_price_cents": F.coalesce(F.col("bad_price"), F.lit(False)),
        "bin": length("card_bin", BIN_LENGTH, BIN_LENGTH),
        "last4": length("last4", LAST4_LENGTH, LAST4_LENGTH),
        "card_country": length("card_country", COUNTRY_LENGTH, COUNTRY_LENGTH),
        "billing_country": length("billing_country", COUNTRY_LENGTH, COUNTRY_LENGTH),
        "shipping_country": length("shipping_country", COUNTRY_LENGTH, COUNTRY_LENGTH),
        "ip_country": F.length(ip) != COUNTRY_LENGTH,
        "coupon_code": F.coalesce(F.length("coupon_code") > 64, F.lit(False)),
        "total_cents": F.col("total_cents").isNotNull()
        & _outside(F.col("total_cents"), 0, MAX_CENTS),
    }
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return checked.withColumn("failed_rules", failed).drop(
        "item_count", "bad_sku", "bad_quantity", "bad_price"
    )


def valid_note(note: Column) -> Column:
    return F.coalesce(F.length(note) <= MAX_NOTE, F.lit(True))


def scoring_request_error(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``error``: the first failed rule's message, or an empty text.

    ``lines`` has ``line_number``; the first bad line is the one named.
    """
    bad = F.when(
        F.col("quantity") < 1, F.struct("line_number", "sku", F.col("quantity").alias("q"))
    )
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_items"), F.min(bad).alias("_bad")
    )
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
    error = (
        F.when(blank("order_id"), "order_id is required")
        .when(blank("customer_id"), "customer_id is required")
        .when(
            F.col("total_cents") < 0,
            F.concat(
                F.lit("total_cents must not be negative (got "),
                F.col("total_cents").cast("string"),
                F.lit(")"),
            ),
        )
        .when(F.coalesce(F.col("_items"), F.lit(0)) == 0, "at least one line item is required")
        .when(
            F.col("_bad").isNotNull(),
            F.concat(
                F.lit("item '"),
                F.col("_bad.sku"),
                F.lit("' has quantity "),
                F.col("_bad.q").cast("string"),
                F.lit(", must be >= 1"),
            ),
        )
        .otherwise("")
    )
    return orders.join(per_order, "order_id", "left").withColumn("error", error).drop(
        "_items", "_bad"
    )


def _merged(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id", "sku").agg(
        F.sum("quantity").alias("quantity"),
        F.min("unit_price_cents").alias("unit_price_cents"),
        F.max("unit_price_cents").alias("highest_price_cents"),
    )


def price_conflicts(lines: DataFrame) -> DataFrame:
    """SKUs an order lists at two prices. Such an order is rejected whole."""
    return _merged(lines).filter(F.col("unit_price_cents") != F.col("highest_price_cents"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """One line per SKU for every order without a price conflict."""
    merged = _merged(lines)
    refused = price_conflicts(lines).select("order_id").distinct()
    return merged.join(refused, "order_id", "left_anti").drop("highest_price_cents")


def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The given total, even where it disagrees, else the sum over the lines."""
    computed = lines.groupBy("order_id").agg(
        F.sum(F.col("unit_price_cents") * F.col("quantity")).alias("_computed")
    )
    return orders.join(computed, "order_id", "left").withColumn(
        "total_cents", F.coalesce(F.col("total_cents"), F.col("_computed"), F.lit(0))
    ).drop("_computed")


def public_hold_reason(status: Column, hold_reason: Column) -> Column:
    """What a customer may read: never why the model held the order."""
    return F.when(
        hold_reason.isNotNull() & ~status.isin(*UNDISCLOSED_STATUSES), PUBLIC_HOLD_TEXT
    )


def visible_to(orders: DataFrame, principal, supervisor: bool = False) -> DataFrame:
    return orders if supervisor else orders.filter(F.col("customer_id") == F.lit(principal))
