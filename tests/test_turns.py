"""Allocation at each order's turn against the sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import flow, turns
from orderlens.streaming import events, run
from tests import models
from tests.test_stock import LINES, line_frame, random_orders, stock_frame


def outcomes(df):
    return {r.order_id: (r.warehouse_id, r.reserved) for r in df.collect()}


@pytest.mark.parametrize(("slice_lines", "hot_rows"), [(1, 6), (25, 1_000_000), (100_000, 6)])
@pytest.mark.parametrize("seed", range(2))
def test_live_picks_match_brute_force(spark, seed, slice_lines, hot_rows):
    stock, orders = random_orders(seed, 12 if slice_lines == 1 else 80)
    got = turns.allocate_in_turn(
        line_frame(spark, orders), stock_frame(spark, stock), slice_lines=slice_lines, hot_rows=hot_rows
    )
    want, left = models.allocate(stock, orders, live_picks=True)
    assert outcomes(got) == want
    assert min(left.values()) >= 0


def test_many_components_side_by_side(spark):
    """Unconnected groups of SKUs, one of them holding half of the orders."""
    rng = random.Random(3)
    stock = {(f"W{w}", f"{g}-{s}"): rng.randrange(4, 30) for w in range(3) for g in range(12) for s in range(3)}
    orders = {}
    for seq in range(240):
        g = 0 if seq % 2 else rng.randrange(12)
        skus = rng.sample(range(3), rng.randrange(1, 4))
        orders[f"O-{seq}"] = (rng.randrange(60), seq, [(f"{g}-{s}", rng.randrange(1, 5)) for s in skus])
    got = turns.allocate_in_turn(line_frame(spark, orders), stock_frame(spark, stock), slice_lines=60)
    assert outcomes(got) == models.allocate(stock, orders, live_picks=True)[0]


def test_lines_that_nothing_covers(spark):
    cells = stock_frame(spark, {("A", "x"): 5, ("B", "x"): None})
    rows = [
        ("O-1", 1, 1, None, 1),
        ("O-2", 2, 2, "x", 1),
        ("O-2", 2, 2, None, 1),
        ("O-3", 3, 3, "x", None),
        ("O-4", 4, 4, "x", 0),
        ("O-5", 5, 5, "q", 1),
        ("O-6", 6, 6, "x", 5),
        ("O-7", 7, 7, "x", 1),
    ]
    out = turns.allocate_in_turn(spark.createDataFrame(rows, LINES), cells)
    got = {r.order_id: (r.warehouse_id, r.reason) for r in out.collect()}
    none = (None, "no warehouse holds these items")
    assert got == {
        "O-1": none,
        "O-2": ("A", "insufficient stock"),
        "O-3": none,
        "O-4": none,
        "O-5": none,
        "O-6": ("A", None),
        "O-7": none,
    }
    assert turns.allocate_in_turn(spark.createDataFrame([], LINES), cells).count() == 0


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", "z"), ("a1", "a2"), ("a3", "a2")]
    got = {r.node: r.component for r in turns.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert len(got) == 45
    assert {c for n, c in got.items() if n.startswith("n")} == {"n000"}
    assert (got["z"], got["a2"], got["a3"]) == ("z", "a1", "a1")


ROUTED = (
    "order_id string, t long, seq long, score double, band string, action string, route_reason string, "
    "items array<struct<sku: string, quantity: int>>"
)


def some_routed(seed):
    stock, orders = random_orders(seed, 90)
    rows = [
        (o, t, seq, 0.1, "low", "approve", "fine", lines)
        if seq % 5
        else (o, t, seq, 0.9, "high", "review", "risky", lines)
        for o, (t, seq, lines) in sorted(orders.items(), key=lambda o: o[1][:2])
    ]
    approved = {o: v for o, v in orders.items() if v[1] % 5}
    return stock, rows, models.allocate(stock, approved, live_picks=True)


def test_approval_never_oversells(spark):
    stock, rows, (want, _) = some_routed(4)
    routed = spark.createDataFrame(rows, ROUTED)
    lines = routed.select("order_id", "t", "seq", F.inline("items"))
    out = {r.order_id: r for r in flow.outcome_in_turn(routed, lines, stock_frame(spark, stock)).collect()}
    assert len(out) == len(rows)
    used: dict = {}
    for order_id, *_, action, _, items in rows:
        r = out[order_id]
        assert (r.status == "reserved") == (action == "approve" and want[order_id][1])
        assert r.needs_review == (r.status != "reserved")
        if action == "review":
            assert (r.hold_reason, r.warehouse_id) == ("risky", None)
        else:
            assert r.warehouse_id == want[order_id][0]
        if r.status == "reserved":
            for sku, q in items:
                used[r.warehouse_id, sku] = used.get((r.warehouse_id, sku), 0) + q
    assert all(n <= stock[cell] for cell, n in used.items())


def test_decisions_of_batches_are_those_of_one_table(spark, tmp_path):
    """Wherever the stream is cut, also by a restart and a batch that runs twice."""
    stock, rows, (want, left) = some_routed(6)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    opening = stock_frame(spark, stock)
    writer = events.decision_writer(opening, out)
    for part in (rows[:20], rows[20:70], rows[70:]):
        spark.createDataFrame(part, ROUTED).coalesce(1).write.mode("append").parquet(folder)
        source = run.file_stream(spark, folder, "*.parquet", 1)
        run.catch_up_batches(source, writer, str(tmp_path / "check"))
    writer(spark.createDataFrame(rows[70:], ROUTED), 2)
    got = {
        r.order_id: (r.warehouse_id, r.status == "reserved")
        for r in spark.read.parquet(f"{out}/decisions").filter("action = 'approve'").collect()
    }
    assert got == want
    after = spark.read.parquet(f"{out}/stock/batch=2").collect()
    assert {(r.warehouse_id, r.sku): r.available for r in after} == left


def test_orders_that_nothing_covers_leave_the_rounds(spark, monkeypatch):
    """Once the stock is gone no order is walked, but each still has its pick."""
    rng = random.Random(5)
    stock = {(f"W{w}", f"s{s}"): rng.randrange(1, 9) for w in range(3) for s in range(4)}
    stock["W2", "s3"] = 40
    orders = {
        f"O-{seq}": (seq // 2, seq, [(f"s{s}", rng.randrange(1, 4)) for s in rng.sample(range(4), rng.randrange(1, 4))])
        for seq in range(400)
    }
    walked = []
    plain = turns.remaining_stock
    monkeypatch.setattr(turns, "remaining_stock", lambda *a: walked.append(1) or plain(*a))
    got = turns.allocate_in_turn(line_frame(spark, orders), stock_frame(spark, stock), slice_lines=40, hot_rows=30)
    assert outcomes(got) == models.allocate(stock, orders, live_picks=True)[0]
    # about 20 slices of 40 lines
    assert 1 < len(walked) < 10
