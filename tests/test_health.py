import math
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from orderlens.functions import clock
from orderlens.operators import metrics, reconcile, reviews

BOUNDS = metrics.LATENCY_BUCKETS


def log_and_ledger(spark):
    log = spark.range(12).select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"),
        F.concat(F.lit("O"), F.col("id")).alias("order_id"),
        F.lit("order.accepted").alias("event_type"),
    )
    ledger = (
        log.filter("event_id <> 'e3'")
        .select("event_id")
        .union(spark.createDataFrame([("ghost",)], "event_id string"))
        .select("event_id", F.lit("t").alias("topic"), F.lit("g").alias("consumer_group"))
    )
    return log, ledger


STOCK = "warehouse_id string, sku string, on_hand long, reserved long, available long"


def test_equal_counts_still_differ_by_identity(spark):
    log, ledger = log_and_ledger(spark)
    assert log.count() == ledger.count()
    assert [r.event_id for r in reconcile.missing(log, ledger).collect()] == ["e3"]
    assert [r.event_id for r in reconcile.orphaned(log, ledger, "t", "g").collect()] == ["ghost"]
    assert reconcile.orphaned(log, ledger, "stock", "g").count() == 0


def test_report_names_every_failure(spark):
    log, ledger = log_and_ledger(spark)
    stock = spark.createDataFrame([("W", "a", 5, 0, -5), ("W", "b", 100, 5, 90)], STOCK)
    row = reconcile.report(log, ledger, stock, log, "t", "g").first()
    assert row.failures == [
        "events never applied", "effects without an event", "negative stock", "inconsistent stock",
    ]
    good = spark.createDataFrame([("W", "a", 5, 0, 5)], STOCK)
    own = ledger.filter("event_id <> 'ghost'")
    row = reconcile.report(log.filter("event_id <> 'e3'"), own, good, log, "t", "g").first()
    assert row.passed and row.failures == []


def test_a_run_without_a_log_never_passes(spark):
    log, ledger = log_and_ledger(spark)
    good = spark.createDataFrame([("W", "a", 5, 0, 5)], STOCK)
    row = reconcile.report(None, ledger, good, log, "t", "g").first()
    assert not row.passed and row.failures == ["no readable event log"]


RUN = {
    "producer_per_sec": 500.0, "end_to_end_per_sec": 36.0, "drain_per_sec": 36.0, "drain_timed_out": False,
    "unaccounted_orders": 0, "scoring_p95_ms": 5.0, "oversells": 0,
}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"producer_per_sec": 399.0}, ["producer throughput"]),
        ({"scoring_p95_ms": 200.1}, ["scoring p95"]),
        ({"oversells": 1}, ["oversells"]),
        ({"drain_per_sec": 19.0, "unaccounted_orders": 2}, ["drain rate", "unaccounted orders"]),
        ({"drain_timed_out": True, "unaccounted_orders": 635, "drain_per_sec": 1.0}, ["backlog not drained"]),
    ],
)
def test_budget(spark, change, want):
    values = RUN | change
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    assert reconcile.budget_breaches(row).first().breaches == want


def samples(spark, values, label="a"):
    return spark.createDataFrame(
        [(label, float(v), i) for i, v in enumerate(values)], "label string, ms double, i long"
    )


def test_bucket_percentiles_are_bounds(spark):
    df = samples(spark, [1, 2, 3, 50, 120, 190])
    buckets = metrics.histogram(df, F.col("ms") / 1000, BOUNDS, ["label"])
    row = metrics.bucket_percentiles(buckets, {"p50": 0.5, "p95": 0.95}, ["label"]).first()
    assert (row.p50, row.p95, row.observations) == (0.005, 0.2, 6)
    counts = [r.cumulative for r in buckets.filter("le is not null").orderBy("le").collect()]
    assert counts == [bisect_left([1, 2, 3, 50, 120, 190], b * 1000 + 1e-9) for b in BOUNDS]


def test_a_rank_beyond_the_last_bound_gives_the_last_bound(spark):
    buckets = metrics.histogram(samples(spark, [5000, 6000]), F.col("ms") / 1000, BOUNDS, ["label"])
    assert metrics.interpolated_quantiles(buckets, {"q": 0.5}, ["label"]).first().q == BOUNDS[-1]
    row = metrics.bucket_percentiles(buckets, {"q": 0.5}, ["label"]).first()
    assert (row.observations, row.q) == (0, 0.0)


@pytest.mark.parametrize("kept", [1, 5, 10_000])
def test_nearest_rank(spark, kept):
    rng = random.Random(kept)
    by = {
        name: [rng.choice([1.5, 2.5, rng.random() * 100, -rng.random() * 10**9]) for _ in range(n)]
        for name, n in (("a", 1), ("b", 2), ("c", 10), ("d", 1501), (None, 40))
    }
    by["same"] = [7.0] * 30
    by["steep"] = [2.0**i for i in range(-300, 300)]
    rows = [(name, v) for name, values in by.items() for v in values]
    rows += [("d", None), ("none", None)]
    df = spark.createDataFrame(rows, "label string, ms double").repartition(3)
    fractions = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = metrics.nearest_rank(df, "ms", fractions, ["label"], kept)
    assert got.columns == ["label", *fractions, "count", "max", "mean"]
    got = {r.label: r for r in got.collect()}
    assert set(got) == set(by)
    for name, values in by.items():
        values, n = sorted(values), len(values)
        assert (got[name]["count"], got[name]["max"]) == (n, values[-1])
        for column, f in fractions.items():
            assert got[name][column] == values[min(n - 1, max(0, round(f * n) - 1))], (name, column)


def test_alerts_need_unbroken_windows(spark):
    rows = [("a", w * 60, v) for w, v in enumerate([9, 9, 9, 1, 9, 9])] + [("b", 0, 9), ("b", 120, 9)]
    df = spark.createDataFrame(rows, "label string, window_start long, v int")
    out = metrics.sustained_alerts(df, F.col("v") > 5, ["label"], 60, 120).orderBy("label", "started")
    assert [tuple(r) for r in out.select("label", "started", "ended").collect()] == [
        ("a", 0, 180), ("a", 240, 360),
    ]


def test_heartbeat_gaps(spark):
    beats = [0, 10, 310, 611, 2000, 2001]
    df = spark.createDataFrame([("w", b) for b in beats], "label string, s long").withColumn(
        "ts", clock.from_epoch_seconds(F.col("s"))
    )
    got = sorted(r.gap_seconds for r in metrics.heartbeat_gaps(df, ["label"]).collect())
    assert got == [b - a for a, b in zip(beats, beats[1:]) if b - a > 300]


REVIEWS = "review_id string, order_id string, status string, deadline long"


def review_frame(spark, rows):
    return spark.createDataFrame(rows, REVIEWS).withColumn(
        "sla_deadline", clock.from_epoch_seconds(F.col("deadline"))
    )


def test_review_queue(spark):
    now = clock.ntz("1970-01-01 00:10:00")
    df = review_frame(spark, [("a", "1", "pending", 590), ("b", "2", "pending", 700), ("c", "3", "approved", 1)])
    queue = reviews.pending(df, now, 10).collect()
    assert [(r.review_id, r.seconds_to_breach) for r in queue] == [("a", -10.0), ("b", 100.0)]
    row = reviews.stats(df, now).first()
    assert (row.pending, row.approved, row.sla_breached) == (2, 1, 1)
    assert row.oldest_age_past_deadline_seconds == 10.0
    fresh = reviews.stats(df.filter("review_id = 'b'"), now).first()
    assert fresh.oldest_age_past_deadline_seconds == 0.0


def test_first_decision_wins_and_pending_is_none(spark):
    rows = [("v", "O", "pending", 1, 0), ("v", "O", "rejected", 5, 2), ("v", "O", "approved", 5, 1)]
    df = spark.createDataFrame(
        [(*r, "me") for r in rows],
        "review_id string, order_id string, decision string, t long, seq long, decided_by string",
    )
    got = {r.decision: r.outcome for r in reviews.decide(df).collect()}
    assert got == {"approved": "applied", "rejected": "already_decided"}
    holds = spark.createDataFrame([("O", "W", "held")], "order_id string, warehouse_id string, state string")
    row = reviews.effects(df, holds).first()
    assert (row.order_status, row.reservation_state, row.event_type) == ("approved", "committed", "order.approved")


def test_an_expired_review_cancels(spark):
    df = spark.createDataFrame(
        [("v", "O", "expired", 1, 0, "timer")],
        "review_id string, order_id string, decision string, t long, seq long, decided_by string",
    )
    holds = spark.createDataFrame([("O", "W", "released")], "order_id string, warehouse_id string, state string")
    row = reviews.effects(df, holds).first()
    assert (row.order_status, row.reservation_state, row.event_type) == ("cancelled", None, "order.rejected")


def test_interpolation_follows_the_definition(spark):
    values = [3, 7, 30, 60, 80, 120, 180, 240, 900]
    buckets = metrics.histogram(samples(spark, values), F.col("ms") / 1000, BOUNDS, ["label"])
    q = metrics.interpolated_quantiles(buckets, {"q": 0.9}, ["label"]).first().q
    rank, low, seen = 0.9 * len(values), 0.0, 0
    for bound in BOUNDS:
        count = sum(1 for v in values if v / 1000 <= bound)
        if count >= rank:
            assert math.isclose(q, low + (bound - low) * (rank - seen) / (count - seen))
            break
        low, seen = bound, count
