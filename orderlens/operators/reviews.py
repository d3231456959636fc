"""The review queue, its decisions and their effects, the outbox, the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.clock import add_seconds, seconds_between
from orderlens.plans.running import HOT_ROWS, evaluated_once, first_per_key, row_numbers
from orderlens.plans.single import one_row

# What a decision makes of the order and of its hold.
DECIDED = ("approved", "rejected", "expired")
ORDER_STATUS_OF = {"approved": "approved", "rejected": "rejected", "expired": "cancelled"}
HOLD_STATE_OF = {"approved": "committed", "rejected": "released", "expired": "released"}
NOTE_LENGTH = 200
REASON_LENGTH = 120


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def enqueue(
    held: DataFrame, existing: DataFrame, sla_seconds: int = schemas.REVIEW_SLA_SECONDS
) -> DataFrame:
    """New review items: one per held order that has none yet."""
    fresh = held.join(existing.select("order_id"), "order_id", "left_anti")
    return first_per_key(fresh, ["order_id"], [F.col("received_at"), F.col("seq")]).select(
        F.concat(F.lit("V-"), F.col("order_id")).alias("review_id"),
        "order_id",
        F.lit("pending").alias("status"),
        "score",
        "band",
        add_seconds(F.col("received_at"), sla_seconds).alias("sla_deadline"),
    )


def pending(
    reviews: DataFrame,
    now: Column,
    limit: int | None,
    oldest_first: bool = True,
    status: str = "pending",
) -> DataFrame:
    """The queue by deadline with the seconds left, negative when late."""
    order = F.col("sla_deadline").asc() if oldest_first else F.col("sla_deadline").desc()
    queue = reviews.filter(F.col("status") == status).withColumn(
        "seconds_to_breach", seconds_between(now, F.col("sla_deadline"))
    )
    return queue if limit is None else queue.orderBy(order, "review_id").limit(limit)


def breached(reviews: DataFrame, now: Column) -> DataFrame:
    return reviews.filter((F.col("status") == "pending") & (F.col("sla_deadline") < now))


def decide(decisions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark each decision: the first of a review applies, later ones do not."""
    legal = decisions.filter(F.col("decision").isin(*DECIDED))
    numbered = row_numbers(legal, ["review_id"], "t", "seq", "turn", hot_rows)
    return numbered.withColumn(
        "outcome", F.when(F.col("turn") == 1, "applied").otherwise("already_decided")
    ).drop("turn")


def first_decisions(decisions: DataFrame) -> DataFrame:
    """Only the decisions that apply, combined per review before the shuffle."""
    legal = decisions.filter(F.col("decision").isin(*DECIDED))
    return first_per_key(legal, ["review_id"], [F.col("t"), F.col("seq")])


def stats(reviews: DataFrame, now: Column) -> DataFrame:
    """One row. The oldest age counts from the deadline and is never negative."""
    open_ = F.col("status") == "pending"

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    oldest = F.min(F.when(open_, F.col("sla_deadline")))
    return reviews.agg(
        *[count(F.col("status") == s).alias(s) for s in schemas.REVIEW_STATUSES],
        count(open_ & (F.col("sla_deadline") < now)).alias("sla_breached"),
        F.greatest(F.lit(0.0), F.coalesce(seconds_between(oldest, now), F.lit(0.0))).alias(
            "oldest_age_past_deadline_seconds"
        ),
    )


def notification_body(order_id: Column, decision: Column) -> Column:
    return (
        F.when(
            decision == "approved",
            F.concat(
                F.lit("Order "),
                order_id,
                F.lit(" has been approved and is being prepared for dispatch."),
            ),
        )
        .when(
            decision == "rejected",
            F.concat(F.lit("Order "), order_id, F.lit(" was declined. No payment has been taken.")),
        )
        .otherwise(F.concat(F.lit("Order "), order_id, F.lit(" is no longer under review.")))
    )


def effects(decisions: DataFrame, holds: DataFrame) -> DataFrame:
    """What each applied decision does, one row per decision.

    An expired review cancels the order and is announced as a rejection. Only
    a held reservation moves.
    """
    applied = first_decisions(decisions)
    held = holds.filter(F.col("state") == "held").select("order_id", "warehouse_id")
    choice = F.col("decision")
    return applied.join(held, "order_id", "left").select(
        "review_id",
        "order_id",
        choice.alias("decision"),
        "decided_by",
        _lookup(choice, ORDER_STATUS_OF).alias("order_status"),
        "warehouse_id",
        F.when(F.col("warehouse_id").isNotNull(), _lookup(choice, HOLD_STATE_OF)).alias(
            "reservation_state"
        ),
        F.concat(F.lit("decided_"), choice).alias("audit_action"),
        F.concat(F.lit("order-"), choice).alias("template"),
        notification_body(F.col("order_id"), choice).alias("body"),
        F.when(choice == "approved", "order.approved").otherwise("order.rejected").alias("event_type"),
    )


def decision_events(applied: DataFrame) -> DataFrame:
    """The approved or rejected events with cut notes."""
    return applied.select(
        "event_type",
        "order_id",
        F.to_json(
            F.struct(
                "order_id",
                "review_id",
                "decided_by",
                "decision",
                F.substring(F.col("note"), 1, NOTE_LENGTH).alias("note"),
            )
        ).alias("payload"),
    )


def unsent(outbox: DataFrame, sent: DataFrame, limit: int | None = None) -> DataFrame:
    """Notifications not sent yet; with ``limit`` only so many, the oldest first."""
    waiting = outbox.join(sent.select("notification_id"), "notification_id", "left_anti")
    return waiting if limit is None else waiting.orderBy("created_at", "notification_id").limit(limit)


def mark_sent(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    when = sent.groupBy("notification_id").agg(F.min("sent_at").alias("sent_at"))
    return outbox.drop("sent_at").join(when, "notification_id", "left")


def missing_items(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review items to create for queued tasks that have none."""
    known = F.col("band").isin(*schemas.RISK_BANDS)
    gone = tasks.join(reviews.select("order_id"), "order_id", "left_anti")
    return first_per_key(gone, ["order_id"], [F.col("seq")]).select(
        "order_id",
        "review_id",
        F.lit("pending").alias("status"),
        F.when(known, F.col("band")).otherwise("ambiguous").alias("band"),
        F.substring(F.col("reason"), 1, REASON_LENGTH).alias("reason"),
    )


TASK = "review_id string, order_id string, decision string, decided_by string, note string"


def decode_tasks(messages: DataFrame, body: str = "body") -> DataFrame:
    """Parse queue messages; ``poison`` says why one can never be handled."""
    text = F.col(body)
    parsed = F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, TASK))
    opened = evaluated_once(messages, "_task", parsed)
    task = F.col("_task")
    poison = (
        F.when(task.isNull() | ~F.ltrim(text).startswith("{"), "not a JSON object")
        .when(F.coalesce(task["review_id"], F.lit("")) == "", "no review_id")
        .when(F.coalesce(task["order_id"], F.lit("")) == "", "no order_id")
    )
    kept = [c for c in messages.columns if c != body]
    return opened.select(*kept, "_task.*", poison.alias("poison"))


def timeline(audit: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each entity's audit entries numbered by ``(created at, id)``."""
    return row_numbers(audit, ["entity_id"], "t", "id", "step", hot_rows)


def recent(audit: DataFrame, limit: int, action: str | None = None) -> DataFrame:
    rows = audit if action is None else audit.filter(F.col("action") == action)
    return rows.orderBy(F.desc("t"), F.desc("id")).limit(limit)


def worker_tallies(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: what the review worker did with its messages."""

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    done = decisions.agg(
        count(F.col("outcome") == "applied").alias("processed"),
        count(F.col("outcome") == "already_decided").alias("already_decided"),
        *[
            count((F.col("outcome") == "applied") & (F.col("decision") == d)).alias(d)
            for d in DECIDED
        ],
    )
    bad = tasks.agg(count(F.col("poison").isNotNull()).alias("failed"))
    # every applied decision queues a notification
    return one_row([done, bad]).withColumn("notifications", F.col("processed"))
