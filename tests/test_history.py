import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.functions.clock import from_epoch_seconds
from orderlens.operators import history
from orderlens.plans.running import measure_slices, row_numbers
from tests import models

ORDERS = "customer_id string, t long, seq long, total_cents long, card_bin string"


def frames(spark, orders, chargebacks):
    o = spark.createDataFrame(orders, ORDERS).withColumn(
        "received_at", from_epoch_seconds(F.col("t"))
    )
    c = spark.createDataFrame(chargebacks, "customer_id string, t long, seq long").select(
        "customer_id", "seq", from_epoch_seconds(F.col("t")).alias("charged_at")
    )
    return o, c


def run(spark, orders, chargebacks, hot_rows):
    o, c = frames(spark, orders, chargebacks)
    rows = history.with_history(o, c, hot_rows=hot_rows).collect()
    return {
        r.seq: (
            r.prior_orders,
            r.prior_cents,
            r.prior_bin_orders,
            r.bin_is_new,
            r.velocity_count,
            r.prior_chargeback_count,
        )
        for r in rows
    }


def random_case(seed, n=300, customers=6, span=4000, hot_share=0.4):
    rng = random.Random(seed)
    orders = [
        (
            "C0" if rng.random() < hot_share else f"C{rng.randrange(customers)}",
            rng.randrange(span),
            seq,
            rng.choice([500, 500, 999, 120000, 49999999]),
            rng.choice(["", "411111", "522222", "633333", str(rng.randrange(900))]),
        )
        for seq in range(n)
    ]
    backs = [(f"C{rng.randrange(customers)}", rng.randrange(span), seq) for seq in range(n // 6)]
    return orders, backs


@pytest.mark.parametrize("hot_rows", [1_000_000, 20, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_history_matches_the_sequential_model(spark, seed, hot_rows):
    orders, backs = random_case(seed)
    assert run(spark, orders, backs, hot_rows) == models.history(orders, backs)


@pytest.mark.parametrize("span", [1, 3, 1800])
def test_bursts_at_few_instants_are_sliced_too(spark, span):
    orders, backs = random_case(9, n=200, customers=2, span=span, hot_share=0.9)
    assert run(spark, orders, backs, 8) == models.history(orders, backs)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["A", "B"]),
            st.integers(0, 2000),
            st.integers(1, 10**8),
            st.sampled_from(["", "1", "2"]),
        ),
        min_size=1,
        max_size=25,
    ),
    st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 2500)), max_size=5),
    st.sampled_from([2, 5, 100]),
)
def test_history_property(spark, orders, backs, hot_rows):
    orders = [(c, t, i, cents, b) for i, (c, t, cents, b) in enumerate(orders)]
    backs = [(c, t, i) for i, (c, t) in enumerate(backs)]
    if not backs:
        backs = [("nobody", 0, 0)]
    assert run(spark, orders, backs, hot_rows) == models.history(orders, backs)


def test_hot_keys_are_really_cut(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), "id", F.lit(0).alias("t"))
    cut = measure_slices(df, ["k"], "id", "id", 100)
    sizes = cut.apply(df, "id", "id").groupBy(*cut.group).count().collect()
    assert len(cut.levels) >= 1
    assert max(r["count"] for r in sizes) <= 100


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_row_numbers(spark, hot_rows):
    rng = random.Random(3)
    data = [(rng.choice("aab"), rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, p long, i long")
    got = {r.i: r.rn for r in row_numbers(df, ["k"], "p", "i", hot_rows=hot_rows).collect()}
    want = {}
    for key in "ab":
        own = sorted((p, i) for k, p, i in data if k == key)
        want.update({i: n + 1 for n, (_, i) in enumerate(own)})
    assert got == want


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_row_numbers_with_string_ids_and_skewed_positions(spark, hot_rows):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.choice([None, 1.0, 2.0, 2.0**rng.randrange(60)]), f"e-{i:x}") for i in range(600)]
    df = spark.createDataFrame(data, "k string, p double, i string")
    got = {r.i: r.rn for r in row_numbers(df, ["k"], "p", "i", hot_rows=hot_rows).collect()}
    want = {}
    for key in "ab":
        own = sorted((-1 if p is None else p, i) for k, p, i in data if k == key)
        want.update({i: n + 1 for n, (_, i) in enumerate(own)})
    assert got == want
    cut = measure_slices(df, ["k"], "p", "i", hot_rows)
    sizes = cut.apply(df, "p", "i").groupBy(*cut.group).count().collect()
    assert max(r["count"] for r in sizes) <= hot_rows


def test_effects_of_a_hot_order_with_string_ids(spark):
    from orderlens.operators import delivery

    rows = [("O-1", f"evt-{i * 7 % 50:02d}", i // 10) for i in range(50)]
    df = spark.createDataFrame(rows, "order_id string, event_id string, t long")
    got = {r.event_id: r.step for r in delivery.effects_in_order(df, "t", hot_rows=5).collect()}
    assert got == {e: n + 1 for n, (_, e) in enumerate(sorted((t, e) for _, e, t in rows))}


def test_velocity_counts_earlier_orders_only(spark):
    orders = [("C", 60 * i, i, 1000, "411111") for i in range(4)]
    got = run(spark, orders, [("x", 0, 0)], 1_000_000)
    assert [got[i][4] / 5 for i in range(4)] == [0, 0.2, 0.4, 0.6]


def test_the_window_edge_is_inside(spark):
    orders = [("C", 0, 0, 1, "1"), ("C", 900, 1, 1, "1"), ("C", 1801, 2, 1, "1")]
    got = run(spark, orders, [("x", 0, 0)], 1_000_000)
    assert [got[i][4] for i in range(3)] == [0, 1, 0]


def feature(spark, **columns):
    base = {
        "total_cents": 5000,
        "prior_orders": 0,
        "prior_cents": 0,
        "prior_cents_sq": 0.0,
        "prior_bin_orders": 0,
        "bin_is_new": True,
        "velocity_count": 0,
        "prior_chargeback_count": 0,
        "distinct_skus": 2,
        "total_quantity": 3,
        "billing_country": "US",
        "card_country": "US",
        "ip_country": "US",
        "shipping_country": "US",
        "coupon_code": None,
        "is_gift_card": False,
        "card_bin": "411111",
        "hour": 12,
    } | columns
    hour = base.pop("hour")
    row = spark.range(1).select(
        *[
            (F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k)
            for k, v in base.items()
        ],
        from_epoch_seconds(F.lit(hour * 3600)).alias("received_at"),
    )
    return history.with_features(row).first()


def test_features_of_a_clean_first_order(spark):
    row = feature(spark)
    assert (row.first_order, row.country_mismatch, row.bin_change, row.velocity) == (1, 0, 0, 0)
    assert row.basket_size == pytest.approx(0.5 * 2 / 8 + 0.5 * 3 / 16)


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [("US", "us ", 0), ("US", "DE", 1), ("", "DE", 0), (" ", "DE", 1), (None, "DE", 0)],
)
def test_country_mismatch(spark, left, right, want):
    assert feature(spark, billing_country=left, shipping_country=right).country_mismatch == want


@pytest.mark.parametrize("past", [[100, 100], [100, 100, 100], [100, 200, 400], [5, 5, 5, 6]])
@pytest.mark.parametrize("amount", [50, 100, 150, 10**6])
def test_zscore(spark, past, amount):
    row = feature(
        spark,
        total_cents=amount,
        prior_orders=len(past),
        prior_cents=sum(past),
        prior_cents_sq=float(sum(p * p for p in past)),
    )
    assert row.amount_zscore == pytest.approx(models.zscore(past, amount) / 4)


def test_bin_change_and_chargebacks(spark):
    row = feature(spark, prior_orders=8, prior_bin_orders=8, prior_chargeback_count=1)
    assert (row.bin_change, row.prior_chargebacks) == (1, 0.5)
    assert feature(spark, prior_orders=2, prior_bin_orders=0).bin_change == 0
    assert feature(spark, prior_orders=2, prior_bin_orders=1, card_bin="").bin_change == 1
    assert feature(spark, prior_orders=2, prior_bin_orders=1, bin_is_new=False).bin_change == 0


def test_night_hours_are_utc_whatever_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert feature(spark, hour=5).night_hour == 1
        assert feature(spark, hour=6).night_hour == 0
        # these wall-clock times include the hour that this zone skips
        orders = [("C", 1710034200 + 600 * i, i, 1, "1") for i in range(12)]
        got = run(spark, orders, [("x", 0, 0)], 1_000_000)
        assert got == models.history(orders)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_squares_of_large_and_negative_amounts_are_exact(spark):
    amounts = [-1, 0, 3, 2**31, 3_100_000_000, -3_100_000_001, 2**40 + 12345, 2**44 - 1, 7]
    orders = [("C", i, i, cents, "") for i, cents in enumerate(amounts)]
    for hot_rows in (1_000_000, 4):
        o, c = frames(spark, orders, [("D", 1, 1)])
        got = {r.seq: r.prior_cents_sq for r in history.with_history(o, c, hot_rows=hot_rows).collect()}
        for i in range(len(amounts)):
            exact = sum(x * x for x in amounts[:i])
            assert got[i] == pytest.approx(float(exact), rel=1e-15)
