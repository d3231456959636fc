import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderlens.operators import allocation, inventory, ledger
from orderlens.sources import tables
from tests import models

STOCK = "warehouse_id string, sku string, available long"
LINES = "order_id string, seq long, t long, sku string, quantity int"


def stock_frame(spark, stock):
    return spark.createDataFrame([(w, s, a) for (w, s), a in stock.items()], STOCK)


@pytest.mark.parametrize("hot_rows", [30, 1_000_000])
@pytest.mark.parametrize("seed", range(2))
def test_admission_in_order(spark, seed, hot_rows):
    rng = random.Random(seed)
    stock = {(f"W{w}", f"S{s}"): rng.randrange(0, 25) for w in range(2) for s in range(2)}
    requests = [
        (f"W{rng.randrange(3)}", f"S{rng.randrange(2)}", rng.randrange(40), seq, rng.randrange(1, 7))
        for seq in range(150)
    ]
    df = spark.createDataFrame(
        requests, "warehouse_id string, sku string, t long, seq long, quantity int"
    )
    out = inventory.reserve_in_order(df, stock_frame(spark, stock), hot_rows).collect()
    got = {(r.warehouse_id, r.sku, r.seq): r.admitted for r in out}
    assert got == models.admit(stock, requests)


def test_five_hundred_racers_on_ten_units(spark):
    df = spark.range(500).select(
        F.lit("W").alias("warehouse_id"),
        F.lit("S").alias("sku"),
        F.col("id").alias("seq"),
        F.lit(0).cast("bigint").alias("t"),
        F.lit(1).alias("quantity"),
    )
    cells = stock_frame(spark, {("W", "S"): 10})
    assert inventory.reserve_in_order(df, cells, 200).filter("admitted").count() == 10
    assert inventory.admit_units(df, cells, 50).filter("admitted").count() == 10


def random_orders(seed, n=80):
    rng = random.Random(seed)
    stock = {
        (f"W{w}", f"S{s}"): rng.randrange(0, 40) for w in range(3) for s in range(4) if rng.random() < 0.8
    }
    orders = {}
    for seq in range(n):
        skus = rng.sample(range(5), rng.randrange(1, 4))
        orders[f"O-{seq}"] = (rng.randrange(50), seq, [(f"S{s}", rng.randrange(1, 6)) for s in skus])
    return stock, orders


def line_frame(spark, orders):
    return spark.createDataFrame(
        [(o, seq, t, s, q) for o, (t, seq, lines) in orders.items() for s, q in lines], LINES
    )


@pytest.mark.parametrize(("fold_lines", "hot_rows"), [(0, 1_000_000), (10, 6), (100_000, 6)])
@pytest.mark.parametrize("seed", range(2))
def test_allocation_matches_brute_force(spark, seed, fold_lines, hot_rows):
    stock, orders = random_orders(seed)
    out = allocation.allocate(
        line_frame(spark, orders),
        stock_frame(spark, stock),
        fold_lines=fold_lines,
        hot_rows=hot_rows,
    ).collect()
    want, left = models.allocate(stock, orders)
    assert {r.order_id: (r.warehouse_id, r.reserved) for r in out} == want
    assert min(left.values()) >= 0


@pytest.mark.parametrize("seed", range(2))
def test_later_orders_are_refused_by_what_first_ones_leave(spark, seed, monkeypatch):
    stock, orders = random_orders(seed, n=400)
    walked = []
    settled = allocation._settled

    def counted(state, *args):
        walked.append(state.count())
        return settled(state, *args)

    monkeypatch.setattr(allocation, "_settled", counted)
    out = allocation.allocate(
        line_frame(spark, orders), stock_frame(spark, stock), fold_lines=10, first_lines=60
    ).collect()
    want, _ = models.allocate(stock, orders)
    assert {r.order_id: (r.warehouse_id, r.reserved) for r in out} == want and len(out) == len(want)
    # the stock is gone early, so most lines never compete
    assert len(walked) > 1 and sum(walked) < sum(len(lines) for *_, lines in orders.values()) * 0.6


def test_batches_of_one_order_pick_live(spark):
    stock, orders = random_orders(5, n=6)
    cells = stock_frame(spark, stock)
    got = {}
    for order_id, (t, seq, lines) in sorted(orders.items(), key=lambda o: o[1][:2]):
        one = line_frame(spark, {order_id: (t, seq, lines)})
        done = allocation.allocate(one, cells)
        got.update({r.order_id: (r.warehouse_id, r.reserved) for r in done.collect()})
        cells = stock_frame(
            spark,
            {
                (r.warehouse_id, r.sku): r.available
                for r in allocation.remaining_stock(cells, one, done).collect()
            },
        )
    assert got == models.allocate(stock, orders, live_picks=True)[0]


def test_all_or_nothing_and_most_headroom(spark):
    cells = stock_frame(spark, {("A", "x"): 10, ("A", "y"): 1, ("B", "z"): 5, ("C", "z"): 500})
    lines = spark.createDataFrame(
        [("O-1", 1, 1, "x", 2), ("O-1", 1, 1, "y", 5), ("O-2", 2, 2, "z", 1), ("O-3", 3, 3, "q", 1)],
        LINES,
    )
    out = {r.order_id: r for r in inventory.reserve_from_snapshot(lines, cells).collect()}
    assert (out["O-1"].warehouse_id, out["O-1"].reason) == ("A", "insufficient stock")
    assert (out["O-2"].warehouse_id, out["O-2"].reserved) == ("C", True)
    assert out["O-3"].reason == "no warehouse holds these items"


CELLS = "warehouse_id string, sku string, on_hand long, reserved long, available long, version long"
MOVES = "warehouse_id string, sku string, kind string, quantity int, t long, seq long"


@pytest.mark.parametrize("hot_rows", [8, 1000])
def test_ledger_cycles(spark, hot_rows):
    stock = spark.createDataFrame([("W", "S", 10, 0, 10, 0), ("W", "T", 1, 0, 1, 0)], CELLS)
    moves = []
    for i in range(5):
        moves += [("W", "S", "reserve", 2, 10 * i, 2 * i), ("W", "S", "commit", 2, 10 * i + 1, 2 * i + 1)]
    moves.append(("W", "T", "release", 1, 0, 99))
    df = spark.createDataFrame(moves, MOVES)
    got = {r.sku: r for r in ledger.replay_ledger(stock, df, hot_rows).collect()}
    assert (got["S"].on_hand, got["S"].reserved, got["S"].available, got["S"].version) == (0, 0, 0, 10)
    assert (got["S"].refused, got["T"].refused) == (0, 1)
    assert (got["T"].reserved, got["T"].available) == (0, 1)


def some_movements(seed, n=600):
    """Mostly of one cell; some of cells without stock, some that no guard can let through."""
    rng = random.Random(seed)
    cells = [("W", "S")] * 8 + [("W", "T"), ("V", "S"), ("V", "gone"), (None, "S"), ("W", None)]
    rows = []
    for i in range(n):
        kind = rng.choice(["reserve", "reserve", "commit", "release", "release", "lost"])
        quantity = rng.choice([1, 1, 2, 3, 5, 8, 0, -1, None] if i % 9 == 0 else [1, 2, 3, 5, 8])
        rows.append((*rng.choice(cells), kind, quantity, rng.randint(0, n // 3), i))
    return rows


OPENING = [("W", "S", 60, 7, 53, 4), ("W", "T", 3, 0, 3, 0), ("V", "S", 20, 20, 0, 1), ("X", "S", 5, 0, 5, 0)]


@pytest.mark.parametrize("hot_rows", [200, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_guards_against_a_sequential_ledger(spark, seed, hot_rows):
    rows = some_movements(seed)
    stock = spark.createDataFrame(OPENING, CELLS)
    df = spark.createDataFrame(rows, MOVES).withColumn("note", F.concat(F.lit("n"), "seq")).repartition(3)
    cells, applied = models.ledger(OPENING, rows)
    moves = ledger.guarded_moves(stock, df, hot_rows)
    assert moves.columns == [*df.columns, "applied"]
    got = moves.collect()
    assert len(got) == len(rows) and all(r.note == f"n{r.seq}" for r in got)
    assert {r.seq for r in got if r.applied} == applied
    refused = Counter((r[0], r[1]) for r in rows if r[5] not in applied)
    out = {(r[0], r[1]): tuple(r)[2:] for r in ledger.replay_ledger(stock, df, hot_rows).collect()}
    assert out == {cell: (*state, refused[cell]) for cell, state in cells.items()}


def test_movements_without_a_stock_row_are_refused(spark):
    stock = spark.createDataFrame([("W", "S", 10, 0, 10, 0)], CELLS)
    moves = [("W", "S", "reserve", 2, 1, 1), ("W", "gone", "reserve", 1, 2, 2),
             ("V", "S", "commit", 3, 3, 3), ("W", None, "release", 1, 4, 4)]
    df = spark.createDataFrame(moves, MOVES)
    refused = ledger.refused_movements(stock, df)
    assert sorted(r.seq for r in refused.collect()) == [2, 3, 4]
    applied = ledger.replay_ledger(stock, df).agg({"version": "sum"}).first()[0]
    assert applied + refused.count() == len(moves)
    nothing = spark.createDataFrame([], MOVES)
    assert [tuple(r) for r in ledger.replay_ledger(stock, nothing).collect()] == [("W", "S", 10, 0, 10, 0, 0)]


def test_first_transition_settles_a_hold(spark):
    holds = spark.createDataFrame([("R", "O", "W")], "reservation_id string, order_id string, warehouse_id string")
    moves = spark.createDataFrame(
        [("R", "release", 9), ("R", "commit", 5)], "reservation_id string, transition string, t long"
    )
    row = inventory.settle_reservations(holds, moves).first()
    assert (row.state, row.noops) == ("committed", 1)


def test_reset_and_insert_stock(spark):
    schema = "warehouse_id string, sku string, on_hand long, reserved long, available long, version long"
    old = spark.createDataFrame([("W", "a", 9, 4, 5, 3), ("W", "b", 1, 0, 1, 0)], schema)
    new = spark.createDataFrame([("W", "a", 50), ("W", "c", 7)], "warehouse_id string, sku string, on_hand long")
    got = {r.sku: tuple(r)[2:] for r in tables.reset_stock(old, new).collect()}
    assert got == {"a": (50, 0, 50, 4), "b": (1, 0, 1, 0), "c": (7, 0, 7, 0)}
    with pytest.raises(Exception, match="stock exists"):
        tables.insert_stock(old, new).collect()
    assert tables.insert_stock(old, new.filter("sku = 'c'")).count() == 3
