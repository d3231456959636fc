"""The order flow as one batch: claim, score, route, allocate, write out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators import delivery, inventory, scoring, turns
from orderlens.plans.single import one_row

STOCK_HOLD = "stock unavailable: "


def decide(
    records: DataFrame, ledger: DataFrame, routed: DataFrame, lines: DataFrame, stock: DataFrame
) -> DataFrame:
    """The decision on every event that this batch has to work on.

    ``records`` are deliveries (``event_id, order_id, tie``), ``routed`` the
    scored and routed orders. An order without a score is held for a person.
    """
    work = (
        delivery.classify_claims(records, ledger, position="tie")
        .filter(F.col("claim") != "duplicate")
        .select("event_id", "order_id", "claim")
    )
    return outcome(work.join(routed, "order_id", "left"), lines, stock)


def outcome(routed: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Join approved orders with their stock outcome.

    Approved but not reservable goes to review like a held order.
    """
    # against a snapshot orders do not compete, so all are tried and only the
    # approved ones use the answer: the scores are computed once
    return _with_stock(routed, inventory.reserve_from_snapshot(lines, stock))


def outcome_in_turn(routed: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """The same where approved orders compete: each gets its stock at its turn.

    ``lines`` also has ``t, seq``. What is reserved never exceeds the stock. An
    order in ``routed`` several times is allocated once. ``routed`` is read twice
    and should be pinned.
    """
    asked = routed.filter(F.col("action") == "approve").select("order_id").distinct()
    competing = lines.join(asked, "order_id", "left_semi")
    return _with_stock(routed, turns.allocate_in_turn(competing, stock))


def _with_stock(routed: DataFrame, outcomes: DataFrame) -> DataFrame:
    granted = outcomes.select(
        "order_id",
        F.col("warehouse_id").alias("_at"),
        F.col("reserved").alias("_ok"),
        F.col("reason").alias("_why"),
    )
    asked = F.col("action") == "approve"
    both = routed.join(granted, "order_id", "left").withColumns(
        {
            "warehouse_id": F.when(asked, F.col("_at")),
            "reserved": F.when(asked, F.col("_ok")),
            "stock_reason": F.when(asked, F.col("_why")),
        }
    ).drop("_at", "_ok", "_why")
    reserved = F.coalesce(F.col("reserved"), F.lit(False))
    reason = (
        F.when(F.col("score").isNull(), scoring.UNSCORED_REASON)
        .when(F.col("action") == "review", F.col("route_reason"))
        .when(
            ~reserved,
            F.concat(
                F.lit(STOCK_HOLD), F.coalesce("stock_reason", F.lit(inventory.NO_WAREHOUSE))
            ),
        )
    )
    return both.withColumns(
        {
            "status": F.when(reserved, "reserved").otherwise("scored"),
            "hold_reason": reason,
            "needs_review": ~reserved,
        }
    ).drop("reserved")


def outputs(decisions: DataFrame) -> dict[str, DataFrame]:
    """Everything a decided batch writes. ``decisions`` should be pinned."""
    scored = scoring.with_contributions(decisions.filter(F.col("score").isNotNull()))
    top = F.transform(
        F.slice("contributions", 1, 5),
        lambda e: F.struct(
            e["feature"].alias("feature"), e["contribution"].alias("contribution")
        ),
    )
    return {
        "fraud_scores": scored.select(
            "event_id", "order_id", "score", "band", "model_version", scoring.reasons().alias("reasons"),
            top.alias("top_contributions"),
        ),
        "order_status": decisions.select("event_id", "order_id", "status", "hold_reason"),
        "audit_log": decisions.select(
            "event_id",
            F.lit("order").alias("entity"),
            F.col("order_id").alias("entity_id"),
            F.when(F.col("score").isNull(), "held_on_error")
            .when(F.col("needs_review"), "held")
            .otherwise("approved")
            .alias("action"),
        ),
        "events": scored.select(
            "event_id",
            F.lit("order.scored").alias("event_type"),
            "order_id",
            F.to_json(F.struct("order_id", "score", "band", "model_version", "degraded")).alias(
                "payload"
            ),
        ),
        "review_items": decisions.filter("needs_review").select(
            "event_id", "order_id", F.lit("pending").alias("status"), "hold_reason"
        ),
        "reservations": decisions.filter(F.col("status") == "reserved").select(
            "event_id", "order_id", "warehouse_id", F.lit("held").alias("state")
        ),
    }


def tallies(records: DataFrame, ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: what the processor did with a batch."""

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    claims = delivery.classify_claims(records, ledger, position="tie").agg(
        F.count(F.lit(1)).alias("handled"),
        count(F.col("claim") == "duplicate").alias("duplicates"),
    )
    decided = decisions.agg(
        count(F.col("action") == "approve").alias("approved"),
        count(F.col("action") == "review").alias("held"),
        count(F.col("score").isNull()).alias("held_on_error"),
    )
    return one_row([claims, decided])
