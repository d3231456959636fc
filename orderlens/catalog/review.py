"""Queries over the review queue, decisions, the outbox and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog import risk
from orderlens.catalog.registry import query
from orderlens.catalog.stock import NOW
from orderlens.functions.clock import from_epoch_seconds, ntz
from orderlens.operators import reviews

_NOW = f"TIMESTAMP '{NOW}'"


@query(
    "review_enqueue",
    """SELECT 'V-' || order_id AS review_id, order_id, 'pending' AS status, round(score, 6) AS score, band,
         received_at + INTERVAL 3600 SECOND AS sla_deadline
       FROM rt WHERE action = 'review' AND order_id NOT IN (SELECT order_id FROM rev)""",
)
def review_enqueue(spark, sf_dir):
    held = risk.routed(spark, sf_dir).filter(F.col("action") == "review")
    return reviews.enqueue(held, adapter.reviews(spark, sf_dir)).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "reviews_pending_topk",
    f"""SELECT review_id, sla_deadline, epoch(sla_deadline) - epoch({_NOW}) AS seconds_to_breach
        FROM rev WHERE status = 'pending' ORDER BY sla_deadline, review_id LIMIT 50""",
)
def reviews_pending_topk(spark, sf_dir):
    return reviews.pending(adapter.reviews(spark, sf_dir), ntz(NOW), 50).select(
        "review_id", "sla_deadline", "seconds_to_breach"
    )


@query(
    "reviews_breached",
    f"SELECT review_id, order_id FROM rev WHERE status = 'pending' AND sla_deadline < {_NOW}",
)
def reviews_breached(spark, sf_dir):
    return reviews.breached(adapter.reviews(spark, sf_dir), ntz(NOW)).select(
        "review_id", "order_id"
    )


@query(
    "review_decisions",
    """SELECT review_id, seq, decision, decided_by, CASE WHEN row_number() OVER
         (PARTITION BY review_id ORDER BY t, seq) = 1 THEN 'applied' ELSE 'already_decided' END AS outcome
       FROM dec""",
)
def review_decisions(spark, sf_dir):
    return reviews.decide(adapter.review_decisions(spark, sf_dir)).select(
        "review_id", "seq", "decision", "decided_by", "outcome"
    )


@query(
    "review_stats",
    f"""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
          count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'expired') AS expired,
          count(*) FILTER (status = 'pending' AND sla_deadline < {_NOW}) AS sla_breached,
          greatest(0.0::DOUBLE, epoch({_NOW}) - epoch(min(sla_deadline) FILTER (status = 'pending')))
            AS oldest_age_past_deadline_seconds
        FROM rev""",
)
def review_stats(spark, sf_dir):
    return reviews.stats(adapter.reviews(spark, sf_dir), ntz(NOW))


_APPLIED = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY t, seq) AS turn FROM dec) WHERE turn = 1"""


@query(
    "review_effects",
    f"""SELECT d.review_id, d.order_id, decision,
          CASE decision WHEN 'expired' THEN 'cancelled' ELSE decision END AS order_status, h.warehouse_id,
          CASE WHEN h.order_id IS NULL THEN NULL WHEN decision = 'approved' THEN 'committed' ELSE 'released' END AS reservation_state,
          'decided_' || decision AS audit_action, 'order-' || decision AS template,
          'Order ' || d.order_id || CASE decision WHEN 'approved' THEN ' has been approved and is being prepared for dispatch.'
            WHEN 'rejected' THEN ' was declined. No payment has been taken.' ELSE ' is no longer under review.' END AS body,
          CASE decision WHEN 'approved' THEN 'order.approved' ELSE 'order.rejected' END AS event_type
        FROM ({_APPLIED}) d LEFT JOIN (SELECT * FROM rsv WHERE state = 'held') h ON h.order_id = d.order_id""",
)
def review_effects(spark, sf_dir):
    return reviews.effects(
        adapter.review_decisions(spark, sf_dir), adapter.reservations(spark, sf_dir)
    ).drop("decided_by")


def outbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notifications of the decisions, and those already sent."""
    rows = adapter.review_decisions(spark, sf_dir).select(
        F.col("seq").alias("notification_id"),
        "order_id",
        from_epoch_seconds(F.lit(adapter.START) + F.col("t")).alias("created_at"),
    )
    sent = rows.filter(F.col("notification_id") % 8 == 0).select(
        "notification_id", F.col("created_at").alias("sent_at")
    )
    return rows, sent


@query(
    "outbox_unsent",
    """SELECT seq AS notification_id, order_id, TIMESTAMP '2024-01-01' + to_seconds(t) AS created_at
       FROM dec WHERE seq % 8 <> 0""",
)
def outbox_unsent(spark, sf_dir):
    return reviews.unsent(*outbox(spark, sf_dir))


@query(
    "reviews_missing",
    """SELECT order_id, review_id, 'pending' AS status,
         CASE WHEN (seq // 2) % 3 = 0 THEN 'high' ELSE 'ambiguous' END AS band,
         repeat('held because of ', 7) || 'held bec' AS reason
       FROM dec WHERE seq % 2 = 0 AND order_id NOT IN (SELECT order_id FROM rev)""",
)
def reviews_missing(spark, sf_dir):
    key = F.floor(F.col("seq") / 2)
    tasks = adapter.review_decisions(spark, sf_dir).withColumns(
        {
            "band": F.when(key % 3 == 0, "high").otherwise("severe"),
            "reason": F.repeat(F.lit("held because of "), F.lit(20)),
        }
    )
    return reviews.missing_items(tasks, adapter.reviews(spark, sf_dir))


@query(
    "review_tasks_decode",
    """SELECT seq, CASE seq % 40 WHEN 4 THEN NULL WHEN 8 THEN '' ELSE review_id END AS review_id,
         CASE WHEN seq % 40 IN (4, 12) THEN NULL ELSE order_id END AS order_id,
         CASE WHEN seq % 40 = 4 THEN NULL ELSE decision END AS decision,
         CASE seq % 40 WHEN 4 THEN 'not a JSON object' WHEN 8 THEN 'no review_id' WHEN 12 THEN 'no order_id' END AS poison
       FROM dec""",
)
def review_tasks_decode(spark, sf_dir):
    return decoded_tasks(spark, sf_dir).select(
        "seq", "review_id", "order_id", "decision", "poison"
    )


def decoded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.col("seq") % 40
    body = F.to_json(
        F.struct(
            F.when(fault == 8, "").otherwise(F.col("review_id")).alias("review_id"),
            F.when(fault != 12, F.col("order_id")).alias("order_id"),
            "decision",
            "decided_by",
        )
    )
    messages = adapter.review_decisions(spark, sf_dir).select(
        "seq", F.when(fault == 4, F.substring(body, 1, 15)).otherwise(body).alias("body")
    )
    return reviews.decode_tasks(messages)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to four audit entries per order."""
    seq = F.col("seq")

    def entry(number: int, action: str, delay: int, when=None):
        name = F.lit(action) if when is None else F.when(when, action)
        return F.struct(
            F.lit(number).alias("n"), name.alias("action"), F.lit(delay).alias("delay")
        )

    entries = F.array(
        entry(0, "accepted", 0),
        entry(1, "scored", 1),
        entry(2, "held", 1, seq % 8 == 0),
        entry(3, "decided_approved", 600, seq % 16 == 0),
    )
    return (
        adapter.order_arrivals(spark, sf_dir)
        .select("seq", "order_id", "t", F.inline(entries))
        .filter(F.col("action").isNotNull())
        .select(
            (seq * 4 + F.col("n")).alias("id"),
            F.col("order_id").alias("entity_id"),
            "action",
            (F.col("t") + F.col("delay")).alias("t"),
        )
    )


_AUDIT = """
  SELECT seq * 4 + n AS id, order_id AS entity_id, action, t + delay AS t FROM arr
  JOIN (VALUES (0, 'accepted', 0, 1), (1, 'scored', 1, 1), (2, 'held', 1, 8), (3, 'decided_approved', 600, 16))
    v(n, action, delay, m) ON seq % m = 0"""


@query(
    "order_timeline",
    f"""SELECT id, entity_id, action, row_number() OVER (PARTITION BY entity_id ORDER BY t, id) AS step
        FROM ({_AUDIT})""",
)
def order_timeline(spark, sf_dir):
    return reviews.timeline(audit(spark, sf_dir)).select("id", "entity_id", "action", "step")


@query(
    "audit_recent",
    f"SELECT id, entity_id, t FROM ({_AUDIT}) WHERE action = 'held' ORDER BY t DESC, id DESC LIMIT 100",
)
def audit_recent(spark, sf_dir):
    return reviews.recent(audit(spark, sf_dir), 100, "held").select("id", "entity_id", "t")


@query(
    "review_outcomes",
    """SELECT count(*) FILTER (turn = 1) AS processed, count(*) FILTER (turn > 1) AS already_decided,
         count(*) FILTER (turn = 1 AND decision = 'approved') AS approved,
         count(*) FILTER (turn = 1 AND decision = 'rejected') AS rejected,
         count(*) FILTER (turn = 1 AND decision = 'expired') AS expired,
         (SELECT count(*) FROM dec WHERE seq % 40 IN (4, 8, 12)) AS failed,
         count(*) FILTER (turn = 1) AS notifications
       FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY t, seq) AS turn FROM dec)""",
)
def review_outcomes(spark, sf_dir):
    return reviews.worker_tallies(
        decoded_tasks(spark, sf_dir), reviews.decide(adapter.review_decisions(spark, sf_dir))
    )
