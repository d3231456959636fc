"""Each order's view of its customer's past, and the twelve risk features.

All history is one running total over a timeline per customer. An order adds
to the counts, and leaves the velocity window again ``window_seconds`` later
through a second timeline row, so even the windowed count is a running sum. A
chargeback is a row of its own. Hot customers are sliced (``plans.running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.clock import MICROS, add_seconds, epoch_micros, ntz
from orderlens.plans.running import HOT_ROWS, Slices, has_hot_key, measure_slices

# Feature names in model order, and the saturation points.
FEATURE_NAMES = (
    "amount_zscore",
    "velocity",
    "basket_size",
    "country_mismatch",
    "card_country_mismatch",
    "ip_country_mismatch",
    "first_order",
    "night_hour",
    "coupon_first_order",
    "gift_card",
    "prior_chargebacks",
    "bin_change",
)
BASKET_SATURATION = 8.0
VELOCITY_SATURATION = 5.0
ZSCORE_CLAMP = 4.0
ZSCORE_MIN_ORDERS = 3
NIGHT_HOURS = 6
CHARGEBACK_SCALE = 4.0

HISTORY_COLUMNS = (
    "prior_orders",
    "prior_cents",
    "prior_cents_sq",
    "prior_bin_orders",
    "bin_is_new",
    "velocity_count",
    "prior_chargeback_count",
)

# Rows of one instant: orders first, then chargebacks, then window departures.
_KIND = 1 << 50


def with_history(
    orders: DataFrame,
    chargebacks: DataFrame | None = None,
    *,
    volume_from: DataFrame | None = None,
    window_seconds: int = schemas.VELOCITY_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the history columns: everything the customer did before each order.

    ``orders`` has ``customer_id, seq, received_at, total_cents, card_bin`` and
    any other columns, which pass through. ``seq`` is below 2**50 and breaks
    ties in time. ``chargebacks`` has ``customer_id, seq, charged_at``.
    ``volume_from`` is a cheaper superset of ``orders`` for finding hot
    customers (``customer_id, seq, received_at``).
    """
    slices = _measure(volume_from if volume_from is not None else orders, window_seconds, hot_rows)
    timeline = slices.apply(_timeline(orders, chargebacks, window_seconds), "_us", "_tie")
    local = _local_history(timeline, slices)
    own = local.filter(F.col("_kind") == 0)

    bin_window = Window.partitionBy(*slices.group, "_bin").orderBy("_us", "_tie")
    own = own.withColumn("_bin_first", F.row_number().over(bin_window) == 1)
    zero = F.lit(0)
    if slices.any:
        own = own.join(_first_slices(local, slices), [*slices.group, "_bin"], "left")
        own = own.join(_before_slice(local, slices), slices.group, "left")
        before = {name: F.coalesce(F.col(f"_b_{name}"), zero) for name in _SUMS}
        bin_first = F.col("_bin_first") & ((F.col("_slice1") == 0) | F.col("_b_new_bin").isNotNull())
        chargeback_count = before["counted"] + F.when(
            before["orders"] > 0, F.col("_l_chargebacks")
        ).otherwise(F.col("_l_counted"))
    else:
        before = {name: zero for name in _SUMS}
        bin_first = F.col("_bin_first")
        chargeback_count = F.col("_l_counted")

    def total(name: str) -> Column:
        return F.col(f"_l_{name}") + before[name]

    return own.select(
        "order.*",
        total("orders").alias("prior_orders"),
        total("cents").alias("prior_cents"),
        (total("square_high").cast("double") * _LOW + total("square_low")).alias(
            "prior_cents_sq"
        ),
        total("bins").alias("prior_bin_orders"),
        F.coalesce(bin_first & F.col("_bin").isNotNull(), F.lit(False)).alias("bin_is_new"),
        total("recent").alias("velocity_count"),
        chargeback_count.alias("prior_chargeback_count"),
    )


_SUMS = ("orders", "cents", "square_high", "square_low", "bins", "recent", "counted")
_LOW = 1 << 30


# Squares are summed as two exact integers, of 2**30 and of ones, so that the total
# does not depend on the order of addition. An amount is taken apart at 2**22, as its
# square need not fit in 64 bits: amounts are below 2**46 cents, and the sum of a
# customer's squares below 2**93.
def _square_parts() -> tuple[Column, Column]:
    """The part of an amount's square above 2**44, as a multiple of 2**30, and the
    rest."""
    cents = F.col("_cents")
    high, low = F.shiftright(cents, 22), cents.bitwiseAND(F.lit((1 << 22) - 1).cast("bigint"))
    mixed = high * low * 2
    whole = F.shiftleft(high * high, 14) + F.shiftright(mixed, 8)
    rest = F.shiftleft(mixed.bitwiseAND(F.lit(255).cast("bigint")), 22) + low * low
    return whole, rest


def _square_high() -> Column:
    whole, rest = _square_parts()
    return whole + F.shiftright(rest, 30)


def _square_low() -> Column:
    return _square_parts()[1].bitwiseAND(F.lit(_LOW - 1).cast("bigint"))


def _measure(volume: DataFrame, window_seconds: int, hot_rows: int) -> Slices:
    # an order makes two timeline rows
    if not has_hot_key(volume, ["customer_id"], hot_rows // 2):
        return Slices(("customer_id",))
    us = epoch_micros(F.col("received_at"))
    marks = volume.select(
        "customer_id",
        F.inline(
            F.array(
                F.struct(us.alias("_us"), F.col("seq").cast("bigint").alias("_tie")),
                F.struct(
                    (us + window_seconds * MICROS).alias("_us"),
                    (F.col("seq") + 2 * _KIND).cast("bigint").alias("_tie"),
                ),
            )
        ),
    )
    return measure_slices(marks, ["customer_id"], "_us", "_tie", hot_rows)


def _timeline(
    orders: DataFrame, chargebacks: DataFrame | None, window_seconds: int
) -> DataFrame:
    us = epoch_micros(F.col("received_at"))
    seq = F.col("seq").cast("bigint")
    whole = F.struct(*[F.col(c) for c in orders.columns])
    order_type = orders.select(whole.alias("order")).schema["order"].dataType
    no_order = F.lit(None).cast(order_type)
    rows = orders.select(
        "customer_id",
        F.inline(
            F.array(
                F.struct(
                    us.alias("_us"),
                    seq.alias("_tie"),
                    F.lit(0).alias("_kind"),
                    F.col("total_cents").cast("bigint").alias("_cents"),
                    F.when(F.col("card_bin") != "", F.col("card_bin")).alias("_bin"),
                    whole.alias("order"),
                ),
                F.struct(
                    (us + window_seconds * MICROS).alias("_us"),
                    (seq + 2 * _KIND).alias("_tie"),
                    F.lit(2).alias("_kind"),
                    F.lit(None).cast("bigint").alias("_cents"),
                    F.lit(None).cast("string").alias("_bin"),
                    no_order.alias("order"),
                ),
            )
        ),
    )
    if chargebacks is None:
        return rows
    return rows.unionByName(
        chargebacks.select(
            "customer_id",
            epoch_micros(F.col("charged_at")).alias("_us"),
            (F.col("seq") + _KIND).cast("bigint").alias("_tie"),
            F.lit(1).alias("_kind"),
            F.lit(None).cast("bigint").alias("_cents"),
            F.lit(None).cast("string").alias("_bin"),
            no_order.alias("order"),
        )
    )


def _local_history(timeline: DataFrame, slices: Slices) -> DataFrame:
    """Running totals inside one slice of one customer (exclusive of the row)."""
    window = (
        Window.partitionBy(*slices.group)
        .orderBy("_us", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    is_order = F.col("_kind") == 0

    def running(expr: Column) -> Column:
        return F.coalesce(F.sum(expr).over(window), F.lit(0))

    return timeline.withColumns(
        {
            "_l_orders": running(is_order.cast("bigint")),
            "_l_cents": running(F.col("_cents")),
            "_l_square_high": running(_square_high()),
            "_l_square_low": running(_square_low()),
            "_l_bins": running(F.col("_bin").isNotNull().cast("bigint")),
            "_l_recent": running((1 - F.col("_kind")).cast("bigint")),
            "_l_chargebacks": running((F.col("_kind") == 1).cast("bigint")),
        }
    ).withColumn(
        "_l_counted",
        running(((F.col("_kind") == 1) & (F.col("_l_orders") > 0)).cast("bigint")),
    )


def _before_slice(local: DataFrame, slices: Slices) -> DataFrame:
    """Totals of all earlier slices, one row per slice of a hot customer."""
    hot = local.filter(F.col("_slice1") > 0)
    kind = F.col("_kind")
    totals = hot.groupBy(*slices.group).agg(
        F.sum((kind == 0).cast("bigint")).alias("orders"),
        F.sum("_cents").alias("cents"),
        F.sum(_square_high()).alias("square_high"),
        F.sum(_square_low()).alias("square_low"),
        F.sum(F.col("_bin").isNotNull().cast("bigint")).alias("bins"),
        F.sum((1 - kind).cast("bigint")).alias("recent"),
        F.sum((kind == 1).cast("bigint")).alias("chargebacks"),
        F.sum(((kind == 1) & (F.col("_l_orders") > 0)).cast("bigint")).alias("counted_here"),
    )
    window = (
        Window.partitionBy("customer_id")
        .orderBy(*slices.columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def earlier(expr: Column) -> Column:
        return F.coalesce(F.sum(expr).over(window), F.lit(0))

    before = totals.withColumn("_b_orders", earlier(F.col("orders"))).withColumn(
        "_counted",
        F.when(F.col("_b_orders") > 0, F.col("chargebacks")).otherwise(F.col("counted_here")),
    )
    return before.select(
        *slices.group,
        "_b_orders",
        *[
            earlier(F.col(n)).alias(f"_b_{n}")
            for n in ("cents", "square_high", "square_low", "bins", "recent")
        ],
        earlier(F.col("_counted")).alias("_b_counted"),
    )


def _first_slices(local: DataFrame, slices: Slices) -> DataFrame:
    """The slice in which each BIN of a hot customer appears first, a row a BIN:
    a customer may have any number of them."""
    return (
        local.filter((F.col("_slice1") > 0) & F.col("_bin").isNotNull())
        .groupBy("customer_id", "_bin")
        .agg(F.min(F.struct(*slices.columns)).alias("_at"))
        .select(
            "customer_id",
            "_bin",
            *[F.col(f"_at.{c}").alias(c) for c in slices.columns],
            F.lit(True).alias("_b_new_bin"),
        )
    )


def basket_feature(distinct_skus: Column, total_quantity: Column) -> Column:
    return F.least(F.lit(1.0), distinct_skus / F.lit(BASKET_SATURATION)) * 0.5 + F.least(
        F.lit(1.0), total_quantity / F.lit(BASKET_SATURATION * 2)
    ) * 0.5


def country_mismatch(left: Column, right: Column) -> Column:
    """1 when both are known and differ. Blanks count as known text."""
    unknown = (F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == "")
    differ = F.lower(F.trim(left)) != F.lower(F.trim(right))
    return F.when(~unknown & differ, 1.0).otherwise(0.0)


def amount_zscore(cents: Column, orders: Column, total: Column, total_sq: Column) -> Column:
    """Population z-score above the customer's own mean, clamped to [0, 4]."""
    count = F.greatest(orders, F.lit(1)).cast("double")
    mean = total / count
    deviation = F.sqrt(F.greatest(F.lit(0.0), total_sq / count - mean * mean))
    flat = F.when(cents > mean, ZSCORE_CLAMP).otherwise(0.0)
    z = F.greatest(
        F.lit(0.0), F.least(F.lit(ZSCORE_CLAMP), F.try_divide(cents - mean, deviation))
    )
    return (
        F.when(orders < ZSCORE_MIN_ORDERS, 0.0).when(deviation <= 0.0, flat).otherwise(z)
    )


def feature_columns() -> dict[str, Column]:
    """The twelve features of an order that carries its history columns."""
    c = F.col
    first = c("prior_orders") == 0

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    return {
        "amount_zscore": amount_zscore(
            c("total_cents"), c("prior_orders"), c("prior_cents"), c("prior_cents_sq")
        )
        / F.lit(ZSCORE_CLAMP),
        "velocity": F.least(F.lit(1.0), c("velocity_count") / F.lit(VELOCITY_SATURATION)),
        "basket_size": basket_feature(c("distinct_skus"), c("total_quantity")),
        "country_mismatch": country_mismatch(c("billing_country"), c("shipping_country")),
        "card_country_mismatch": country_mismatch(c("card_country"), c("shipping_country")),
        "ip_country_mismatch": country_mismatch(c("ip_country"), c("shipping_country")),
        "first_order": flag(first),
        "night_hour": flag(F.hour("received_at") < NIGHT_HOURS),
        "coupon_first_order": flag(first & (F.coalesce(c("coupon_code"), F.lit("")) != "")),
        "gift_card": flag(F.coalesce(c("is_gift_card"), F.lit(False))),
        "prior_chargebacks": F.when(first, 0.0).otherwise(
            F.least(
                F.lit(1.0),
                CHARGEBACK_SCALE
                * (c("prior_chargeback_count") / F.greatest(c("prior_orders"), F.lit(1))),
            )
        ),
        "bin_change": flag(
            (c("prior_bin_orders") > 0)
            & ((F.coalesce(c("card_bin"), F.lit("")) == "") | c("bin_is_new"))
        ),
    }


def with_features(history: DataFrame) -> DataFrame:
    return history.withColumns(feature_columns())


def order_features(orders: DataFrame, chargebacks: DataFrame | None = None, **options) -> DataFrame:
    """History and all twelve features for every order."""
    return with_features(with_history(orders, chargebacks, **options))


def feature_map() -> Column:
    """The features as one map, a missing feature being 0."""
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in FEATURE_NAMES]),
        F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in FEATURE_NAMES]),
    )


def velocity_as_of(
    orders: DataFrame, moment: str, window_seconds: int = schemas.VELOCITY_SECONDS
) -> DataFrame:
    """Per customer, orders so far and orders inside the window, as of an instant."""
    at = ntz(moment)
    recent = F.col("received_at") >= add_seconds(at, -window_seconds)
    velocity = F.count(F.when(recent, 1))
    return (
        orders.filter(F.col("received_at") <= at)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("orders_so_far"),
            velocity.alias("velocity_count"),
        )
        .withColumn(
            "velocity", F.least(F.lit(1.0), F.col("velocity_count") / F.lit(VELOCITY_SATURATION))
        )
    )
