"""Schemas, enumerations and fixed values of the order-event domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Event types, statuses and states as they appear on the wire.
EVENT_TYPES = (
    "order.accepted",
    "order.scored",
    "order.held",
    "order.approved",
    "order.rejected",
    "inventory.reserved",
    "inventory.released",
    "inventory.committed",
    "inventory.shortfall",
)
ORDER_STATUSES = ("accepted", "scored", "reserved", "approved", "rejected", "cancelled")
REVIEW_STATUSES = ("pending", "approved", "rejected", "expired")
RESERVATION_STATES = ("held", "committed", "released", "expired")
RISK_BANDS = ("low", "ambiguous", "high")

# The defaults of the order flow.
PARTITIONS = 6
LOW_THRESHOLD = 0.35
HIGH_THRESHOLD = 0.65
VELOCITY_SECONDS = 900
RESERVATION_TTL_SECONDS = 900
REVIEW_SLA_SECONDS = 3600
RATE_LIMIT_PER_MINUTE = 600
MAX_ATTEMPTS = 3
LATENCY_BUCKETS_SECONDS = (
    0.005,
    0.010,
    0.025,
    0.050,
    0.075,
    0.100,
    0.150,
    0.200,
    0.300,
    0.500,
    1.000,
    2.000,
)

ITEM = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price_cents", T.LongType()),
    ]
)
STOCK_LINE = T.StructType(
    [T.StructField("sku", T.StringType()), T.StructField("quantity", T.IntegerType())]
)
PAYMENT = T.StructType(
    [
        T.StructField("bin", T.StringType()),
        T.StructField("last4", T.StringType()),
        T.StructField("card_country", T.StringType()),
        T.StructField("billing_country", T.StringType()),
        T.StructField("shipping_country", T.StringType()),
        T.StructField("ip_country", T.StringType()),
        T.StructField("coupon_code", T.StringType()),
        T.StructField("is_gift_card", T.BooleanType()),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("payload", T.StringType()),
    ]
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_DECIDED = _struct(order_id=_S, review_id=_S, decided_by=_S, decision=_S, note=_S)

PAYLOADS: dict[str, T.StructType] = {
    "order.accepted": _struct(
        order_id=_S,
        customer_id=_S,
        items=T.ArrayType(ITEM),
        payment=PAYMENT,
        total_cents=_L,
        idempotency_key=_S,
        received_at=_S,
    ),
    "order.scored": _struct(
        order_id=_S,
        customer_id=_S,
        score=_D,
        band=_S,
        reasons=T.ArrayType(_S),
        rationale=_S,
        model_version=_S,
        latency_ms=_D,
        transport=_S,
        degraded=_B,
    ),
    "order.approved": _DECIDED,
    "order.rejected": _DECIDED,
    "inventory.reserved": _struct(
        order_id=_S,
        warehouse_id=_S,
        lines=T.ArrayType(STOCK_LINE),
        reservation_id=_S,
        expires_at=_S,
    ),
    "inventory.released": _struct(order_id=_S, warehouse_id=_S, reservation_id=_S, reason=_S),
    "inventory.committed": _struct(order_id=_S, warehouse_id=_S, reservation_id=_S),
    "inventory.shortfall": _struct(
        order_id=_S, warehouse_id=_S, requested=T.ArrayType(STOCK_LINE), reason=_S
    ),
}
