"""At-least-once input, effect-once output: claims, keys, attempts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.clock import epoch_micros, epoch_seconds
from orderlens.plans.running import HOT_ROWS, first_per_key, row_numbers

IN_PROGRESS = "accepted"


def first_deliveries(records: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """The first record of each event by ``(partition, offset)`` that the
    ledger has not applied."""
    fresh = records
    if applied is not None:
        fresh = records.join(applied.select("event_id"), "event_id", "left_anti")
    return first_per_key(fresh, ["event_id"], [F.col("partition"), F.col("offset")])


def classify_claims(
    records: DataFrame,
    ledger: DataFrame,
    scores: DataFrame | None = None,
    position: str | tuple[str, ...] = ("partition", "offset"),
) -> DataFrame:
    """Add ``claim`` to every delivery: new, resume or duplicate.

    An event is finished when its ledger effect is past the claim, or a score
    of it exists. Within a batch only the first delivery can do work.
    """
    place = F.struct(*([position] if isinstance(position, str) else position))
    first = records.groupBy("event_id").agg(F.min(place).alias("_first"))
    known = ledger.select("event_id", F.col("effect").alias("_effect"))
    state = first.join(known, "event_id", "left")
    finished = F.coalesce(F.col("_effect") != IN_PROGRESS, F.lit(False))
    if scores is not None:
        done = scores.select("event_id", F.lit(True).alias("_done")).distinct()
        state = state.join(done, "event_id", "left")
        finished = finished | F.col("_done").isNotNull()
    state = state.select(
        "event_id",
        "_first",
        F.when(finished, "duplicate")
        .when(F.col("_effect").isNotNull(), "resume")
        .otherwise("new")
        .alias("_claim"),
    )
    return (
        records.join(state, "event_id")
        .withColumn(
            "claim", F.when(place == F.col("_first"), F.col("_claim")).otherwise("duplicate")
        )
        .drop("_first", "_claim")
    )


def complete_claims(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger with each outcome's effect set, and whether that changed it.

    A repeated outcome counts once; of different ones for an event, which only
    a fault can cause, the first by name is taken.
    """
    new = outcomes.groupBy("event_id").agg(F.min("effect").alias("_new"))
    return (
        ledger.join(new, "event_id", "left")
        .withColumn(
            "changed", F.coalesce(F.col("_new") != F.col("effect"), F.lit(False))
        )
        .withColumn("effect", F.coalesce(F.col("_new"), F.col("effect")))
        .drop("_new")
    )


def applied_events(records: DataFrame, ledger: DataFrame) -> DataFrame:
    return records.join(ledger.select("event_id"), "event_id", "left_semi")


def processed_ids(ledger: DataFrame, topic: str | None, group: str | None) -> DataFrame:
    out = ledger
    if topic is not None:
        out = out.filter(F.col("topic") == topic)
    if group is not None:
        out = out.filter(F.col("consumer_group") == group)
    return out.select("event_id").distinct()


def effects_in_order(ledger: DataFrame, position: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each order's effects numbered in application order."""
    return row_numbers(ledger, ["order_id"], position, "event_id", "step", hot_rows)


def replayed_orders(requests: DataFrame, position: str = "t") -> DataFrame:
    """Answer each request of an idempotency key with the key's first order.

    The first order per key comes from a partial aggregate, so a key that is
    retried endlessly is combined before the shuffle.
    """
    first = requests.groupBy("idempotency_key").agg(
        F.min(F.struct(position, "seq", "order_id")).alias("_first")
    )
    return requests.join(first, "idempotency_key").select(
        *requests.columns,
        F.col("_first.order_id").alias("answered_with"),
        (F.col("seq") != F.col("_first.seq")).alias("is_replay"),
    )


def dead_letters(attempts: DataFrame, max_attempts: int = schemas.MAX_ATTEMPTS) -> DataFrame:
    """Tasks that used up their attempts without success."""
    return (
        attempts.groupBy("task_id", "queue", "partition", "offset")
        .agg(F.max("attempt").alias("attempts"), F.max(F.col("ok").cast("int")).alias("_ok"))
        .filter((F.col("_ok") == 0) & (F.col("attempts") >= max_attempts))
        .drop("_ok")
    )


def blocked_offsets(attempts: DataFrame, max_attempts: int = schemas.MAX_ATTEMPTS) -> DataFrame:
    """Where a log consumer stops: the first record of a partition that fails
    for good."""
    return (
        dead_letters(attempts, max_attempts)
        .groupBy("partition")
        .agg(F.min("offset").alias("blocked_offset"))
    )


def queue_depth(messages: DataFrame) -> DataFrame:
    def held(state: str) -> Column:
        return F.count(F.when(F.col("state") == state, 1)).alias(state)

    return messages.groupBy("queue").agg(held("ready"), held("unacked"), held("dead_letter"))


def rate_limit_decisions(
    requests: DataFrame,
    limit: int = schemas.RATE_LIMIT_PER_MINUTE,
    window_seconds: int = 60,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number each caller's requests within fixed windows; allow up to a limit."""
    placed = requests.withColumns(
        {
            "window_id": F.floor(epoch_seconds(F.col("ts")) / window_seconds).cast("bigint"),
            "_us": epoch_micros(F.col("ts")),
        }
    )
    counted = row_numbers(placed, ["key", "window_id"], "_us", "seq", "count", hot_rows)
    return counted.withColumns(
        {
            "allowed": F.col("count") <= limit,
            "remaining": F.greatest(F.lit(0), limit - F.col("count")),
        }
    ).drop("_us")


def rate_limit_windows(
    requests: DataFrame, limit: int = schemas.RATE_LIMIT_PER_MINUTE, window_seconds: int = 60
) -> DataFrame:
    """The same totals per window without numbering the requests."""
    return (
        requests.groupBy(
            "key",
            F.floor(epoch_seconds(F.col("ts")) / window_seconds).cast("bigint").alias("window_id"),
        )
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("allowed", F.least(F.col("requests"), F.lit(limit).cast("bigint")))
        .withColumn("denied", F.col("requests") - F.col("allowed"))
    )
