import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderlens.functions.clock import add_seconds, from_epoch_seconds
from orderlens.operators import history
from orderlens.streaming import events, run
from orderlens.streaming.history import (
    CustomerHistory,
    OrderedHistory,
    _deal,
    _views,
    history_events,
    stream_history,
    stream_history_in_order,
)
from orderlens.streaming.ledger import stream_ledger
from tests import models
from tests.test_stock import CELLS, MOVES, OPENING, some_movements

ORDERS = "customer_id string, t long, seq long, total_cents long, card_bin string"


def write_orders(spark, folder, orders, files):
    size = -(-len(orders) // files)
    for i in range(files):
        part = orders[i * size : (i + 1) * size]
        if part:
            spark.createDataFrame(part, ORDERS).withColumn(
                "received_at", from_epoch_seconds(F.col("t"))
            ).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, folder, path, checkpoint, files_per_trigger=1):
    source = run.file_stream(spark, folder, "*.parquet", files_per_trigger)
    past = stream_history(
        history_events(
            source, F.lit(True), F.col("seq") % 4 == 0, add_seconds(F.col("received_at"), 50)
        )
    )
    return run.catch_up(past, "t", path, checkpoint)


def as_tuples(rows):
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


def some_orders(n=60):
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 3000, 100) for _ in range(n))
    return [
        (rng.choice("AAB"), t, seq, rng.randrange(1, 10**7), rng.choice(["", "1", "2", "3"]))
        for seq, t in enumerate(times)
    ]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    orders = some_orders()
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    # chargebacks trail by 50 s and files are cut at equal times, so that the
    # arrival order is the time order
    cut = next(i for i in range(30, 60) if orders[i][1] != orders[i - 1][1])
    write_orders(spark, folder, orders[:cut], 1)
    first = streamed(spark, folder, out, check).count()
    write_orders(spark, folder, orders[cut:], 1)
    both = streamed(spark, folder, out, check)
    assert first == cut and both.count() == len(orders)
    again = streamed(spark, folder, out, check)
    backs = [(c, t + 50, seq) for c, t, seq, _, _ in orders if seq % 4 == 0]
    assert as_tuples(again.collect()) == models.history(orders, backs)
    batch = history.with_history(
        spark.createDataFrame(orders, ORDERS).withColumn("received_at", from_epoch_seconds(F.col("t"))),
        spark.createDataFrame(backs, "customer_id string, t long, seq long").select(
            "customer_id", "seq", from_epoch_seconds(F.col("t")).alias("charged_at")
        ),
    )
    assert as_tuples(batch.collect()) == as_tuples(again.collect())


def test_many_bins_are_known_after_a_restart(spark, tmp_path):
    """The first BINs stand beside the sums, the others in a map."""
    orders = [("A", 100 * i, i, 5, str(i % 40)) for i in range(100)]
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write_orders(spark, folder, orders[:50], 1)
    streamed(spark, folder, out, check)
    write_orders(spark, folder, orders[50:], 1)
    rows = streamed(spark, folder, out, check).collect()
    assert {r.seq: r.bin_is_new for r in rows} == {i: i < 40 for i in range(100)}


class _Kept:
    """A state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def containsKey(self, key):  # noqa: N802
        self.calls += 1

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1


def test_a_customer_takes_few_rows_and_calls():
    """A call of the state and a row to Spark each cost more than an order does."""
    one = CustomerHistory()
    one.sums, one.bins = _Kept(), _Kept()
    for batch in range(2):
        rows = [("A", batch * 1000 + i, 0, batch * 1000 + i, 5, str(i % 9)) for i in range(500)]
        views = [*one.handleInputRows(("A",), iter(rows), None)]
        assert [len(v.seq) for v in views] == [500]
    assert one.sums.calls == 2 and one.bins.calls == 0 and one.sums.value[0] == 1000


def test_a_late_order_counts_what_has_arrived(spark, tmp_path):
    """In a stream arrival rules: the late order sees the newer one."""
    folder = str(tmp_path / "in")
    write_orders(spark, folder, [("A", 500, 1, 10, "1")], 1)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streamed(spark, folder, out, check)
    write_orders(spark, folder, [("A", 100, 2, 10, "1")], 1)
    rows = as_tuples(streamed(spark, folder, out, check).collect())
    assert rows[2][0] == 1 and rows[2][4] == 1


def ordered(spark, tmp_path):
    source = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
    past = stream_history_in_order(
        history_events(
            source, F.lit(True), F.col("seq") % 4 == 0, add_seconds(F.col("received_at"), 50)
        ),
        "500 seconds",
    )
    return run.catch_up(past, "t", str(tmp_path / "out"), str(tmp_path / "check"))


def test_orders_out_of_order_are_counted_in_order(spark, tmp_path):
    """Rows shuffled by less than the delay, over files and a restart, equal one batch."""
    orders = some_orders()
    rng = random.Random(9)
    shuffled = sorted(orders, key=lambda o: o[1] + rng.randrange(400))
    assert shuffled != orders
    write_orders(spark, str(tmp_path / "in"), shuffled[:35], 2)
    ordered(spark, tmp_path)
    write_orders(spark, str(tmp_path / "in"), shuffled[35:], 2)
    # one row far ahead lets the watermark pass all the others
    write_orders(spark, str(tmp_path / "in"), [("Z", 90_000, 999, 1, "")], 1)
    rows = ordered(spark, tmp_path).collect()
    backs = [(c, t + 50, seq) for c, t, seq, _, _ in orders if seq % 4 == 0]
    assert as_tuples(rows) == models.history(orders, backs)
    assert not any(r.late for r in rows)


def test_an_order_behind_the_watermark_is_kept_and_flagged(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_orders(spark, folder, [("A", 1000, 1, 10, "1"), ("B", 5000, 2, 10, "1")], 1)
    assert [r.seq for r in ordered(spark, tmp_path).collect()] == [1]
    # behind the watermark: A has counted a newer order, C has counted none
    write_orders(spark, folder, [("A", 900, 3, 10, "1"), ("C", 900, 5, 10, "1"), ("C", 800, 6, 10, "1")], 1)
    write_orders(spark, folder, [("B", 9000, 7, 10, "1")], 1)
    rows = {r.seq: r for r in ordered(spark, tmp_path).collect()}
    assert {s: (r.prior_orders, r.late) for s, r in rows.items()} == {
        1: (0, False),
        2: (0, False),
        3: (1, True),
        5: (1, False),
        6: (0, False),
    }


def test_customers_of_a_group_are_kept_apart(spark, tmp_path):
    """Two groups, a customer without id, BINs beyond the first few that customers
    share, copies of orders, over files and a restart."""
    rng = random.Random(11)
    customers, bins = [*"ABCDEF", None], ["", *map(str, range(30))]
    orders = [
        (rng.choice(customers), 10 * i, i, rng.randrange(1, 10**7), rng.choice(bins)) for i in range(400)
    ]
    shuffled = sorted(orders, key=lambda o: o[1] + rng.randrange(400))

    def go():
        source = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1)
        backs = add_seconds(F.col("received_at"), 50)
        past = stream_history_in_order(
            history_events(source, F.lit(True), F.col("seq") % 4 == 0, backs), "500 seconds", groups=2
        )
        return run.catch_up(past, "t", str(tmp_path / "out"), str(tmp_path / "check"))

    write_orders(spark, str(tmp_path / "in"), shuffled[:200], 2)
    go()
    # the last orders come twice, and the first of a customer does so too late
    again = [orders[-1], orders[-2]]
    write_orders(spark, str(tmp_path / "in"), shuffled[200:] + again, 2)
    write_orders(spark, str(tmp_path / "in"), [("Z", 90_000, 999, 1, "")], 1)
    go()
    write_orders(spark, str(tmp_path / "in"), [("A", 0, 1000, 1, "1")], 1)
    rows = go().collect()
    backs = [(c, t + 50, seq) for c, t, seq, _, _ in orders if seq % 4 == 0]
    want = models.history(orders, backs)
    twice = {o[2] for o in again}
    assert as_tuples(r for r in rows if not r.late and r.seq not in twice) == {
        seq: view for seq, view in want.items() if seq not in twice
    }
    assert sorted(r.seq for r in rows if r.seq in twice) == sorted([*twice, *twice])
    assert {r.prior_orders for r in rows if r.late} == {sum(o[0] == "A" for o in orders + again)}


class _Listed(_Kept):
    """A list state that counts its calls."""

    def __init__(self):
        super().__init__()
        self.value = []

    def get(self):
        self.calls += 1
        return iter(self.value)

    def put(self, values):
        self.value, self.calls = list(values), self.calls + 1

    def appendList(self, values):  # noqa: N802
        self.value, self.calls = self.value + values, self.calls + 1

    def appendValue(self, value):  # noqa: N802
        self.appendList([value])

    def clear(self):
        self.put([])

    registerTimer = deleteTimer = containsKey = _Kept.containsKey


def test_a_group_takes_few_calls_of_the_state():
    """A call costs far more than a row, so it serves many customers."""
    schema = pa.schema(
        [("customer_id", pa.int64()), *((c, pa.int64()) for c in ("us", "kind", "seq", "cents")), ("bin", pa.string())]
    )
    group = OrderedHistory(schema, "bigint")
    group.waiting, group.pasts, group.alarm, group.bins, group.handle = (_Listed() for _ in range(5))
    group.alarm.get = lambda: None
    states = group.waiting, group.pasts, group.alarm, group.bins, group.handle

    class Passed:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10_000_000

    for batch in range(2):
        rows = [(c, batch * 1000 + i, 0, batch * 1000 + i, 5, "1") for c in range(300) for i in range(3)]
        batches = [pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows)), pa.array([7] * 900, pa.int32())], [*schema.names, "group_no"])]
        (dealt,) = _deal(iter(batches), schema)
        assert dealt["group_no"].to_pylist() == [7]
        list(group.handleInputRows((7,), iter([(7, dealt["piece"][0].as_py())]), None))
        (views,) = group.handleExpiredTimer((7,), Passed(), None)
        (found,) = _views(iter([pa.record_batch({"views": [views.views]})]))
        assert Counter(found["prior_orders"].to_pylist()) == {batch * 3 + i: 300 for i in range(3)}
    assert sum(s.calls for s in states) < 40


def test_pieces_hold_the_rows_of_one_group(monkeypatch):
    monkeypatch.setattr("orderlens.streaming.history._DEALT", 20)
    monkeypatch.setattr("orderlens.streaming.history._PIECE", 3)
    schema = pa.schema([("customer_id", pa.string()), ("us", pa.int64()), ("bin", pa.string())])
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(9), rng.choice(["1", None]), rng.randrange(4)) for _ in range(70)]
    batches = [pa.RecordBatch.from_pylist([dict(zip([*schema.names, "group_no"], r)) for r in rows[i : i + 7]]) for i in range(0, 70, 7)]
    got = []
    for dealt in _deal(iter([b.cast(pa.schema([*schema, ("group_no", pa.int32())])) for b in batches]), schema):
        for group, piece in zip(dealt["group_no"].to_pylist(), dealt["piece"].to_pylist()):
            held = pa.ipc.read_record_batch(pa.py_buffer(piece), schema)
            assert 0 < held.num_rows <= 3
            got += [(*r.values(), group) for r in held.to_pylist()]
    assert Counter(got) == Counter(rows)


def test_redelivery_in_a_later_batch_has_no_effect(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(folder)
    writer = run.effect_once_writer(out, "event_id")

    def go():
        source = run.file_stream(spark, folder, "*.parquet", 1)
        run.catch_up_batches(source, writer, str(tmp_path / "check"))

    go()
    spark.range(5, 15).withColumnRenamed("id", "event_id").coalesce(1).write.mode("append").parquet(folder)
    go()
    # a batch that is repeated after a crash replaces its own output
    writer(spark.range(5, 15).withColumnRenamed("id", "event_id"), 1)
    ids = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert ids == list(range(15))


def add_ids(spark, folder, ids):
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.mode("append").parquet(folder)


def test_effects_once_over_a_failure_and_a_restart(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    good = run.batch_writer(out)

    def dies(df, batch_id):
        good(df, batch_id)
        raise RuntimeError("killed after writing")

    def go(write):
        return run.apply_once(run.file_stream(spark, folder, "*.parquet", 1), "event_id", write, check)

    add_ids(spark, folder, [*range(10), 3, None])
    go(good)
    add_ids(spark, folder, range(5, 15))
    with pytest.raises(Exception, match="killed"):
        go(dies)
    go(good)
    add_ids(spark, folder, range(20))
    go(good)
    ids = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert ids == list(range(20))


def test_a_batch_does_not_read_what_was_applied_before(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    read = []
    for start, count in ((0, 500), (1000, 40_000), (100_000, 500)):
        # every batch redelivers a hundred ids of its own
        add_ids(spark, folder, [*range(start, start + count), *range(start, start + 100)])
        source = run.file_stream(spark, folder, "*.parquet", 1)
        done = run.apply_once(source, "event_id", run.batch_writer(out), check)
        read.append(next(b for b in done if b["rows"]))
    small, _, after = read
    assert (small["fresh"], after["fresh"], after["seen"]) == (500, 500, 41_000)
    assert after["state_bytes_read"] <= 2 * small["state_bytes_read"] + 10_000


@pytest.mark.parametrize("delay_between", [30, 300])
def test_copies_inside_the_watermark_are_dropped(spark, tmp_path, delay_between):
    folder = str(tmp_path / "in")
    rows = spark.range(20).select(
        (F.col("id") % 10).alias("event_id"),
        from_epoch_seconds(1000 + F.floor(F.col("id") / 10) * delay_between).alias("ts"),
    )
    rows.coalesce(1).write.parquet(folder)
    source = run.file_stream(spark, folder, "*.parquet")
    kept = events.first_in_watermark(events.with_event_time(source, "ts", "10 minutes"))
    assert run.catch_up(kept.select("event_id"), "d", str(tmp_path / "o"), str(tmp_path / "c")).count() == 10


def test_allocation_carries_stock_between_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "order_id string, seq long, t long, sku string, quantity int"
    orders = {f"O-{i}": (i, i, [("S", 2)]) for i in range(8)}
    for half in (range(4), range(4, 8)):
        spark.createDataFrame([(f"O-{i}", i, i, "S", 2) for i in half], schema).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
    stock = {("A", "S"): 7, ("B", "S"): 4}
    opening = spark.createDataFrame([("A", "S", 7), ("B", "S", 4)], "warehouse_id string, sku string, available long")
    source = run.file_stream(spark, folder, "*.parquet", 1)
    run.catch_up_batches(source, events.allocation_writer(opening, out), str(tmp_path / "check"))
    left = dict(stock)
    want = {}
    for half in (range(4), range(4, 8)):
        part, left = models.allocate(left, {f"O-{i}": orders[f"O-{i}"] for i in half})
        want.update(part)
    got = {r.order_id: (r.warehouse_id, r.reserved) for r in spark.read.parquet(f"{out}/outcomes").collect()}
    assert got == want


def test_guarded_ledger_in_batches(spark, tmp_path):
    """Micro-batches in order leave what one replay leaves, also after a restart."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = sorted(some_movements(5, 240), key=lambda r: (r[4], r[5]))
    stock = spark.createDataFrame(OPENING, CELLS)
    for i in range(0, 240, 80):
        spark.createDataFrame(rows[i : i + 80], MOVES).coalesce(1).write.mode("append").parquet(folder)
        moves = run.file_stream(spark, folder, "*.parquet", 1)
        run.catch_up_batches(
            stream_ledger(moves, stock), run.batch_writer(out), str(tmp_path / "check"), mode="update"
        )
    cells, applied = models.ledger(OPENING, rows)
    refused = Counter((r[0], r[1]) for r in rows if r[5] not in applied)
    got = {(r.warehouse_id, r.sku): r for r in run.latest_rows(out, spark, ["warehouse_id", "sku"]).collect()}
    moved = {(r[0], r[1]) for r in rows}
    assert set(got) == moved
    for cell, r in got.items():
        state = cells.get(cell, (0, 0, 0, 0))
        assert (r.on_hand, r.reserved, r.available, r.version, r.refused) == (*state, refused[cell])


def test_a_cell_takes_its_movements_in_columns():
    """Parts of one micro-batch are put in order together; what is null is refused."""
    from orderlens.streaming.ledger import GuardedLedger

    class Cell:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    ledger = GuardedLedger()
    ledger.cell = Cell()
    opening = pd.DataFrame([("W", "x", 10, 0, 10, 0)], columns=["warehouse_id", "sku", "on_hand", "reserved", "available", "version"])
    ledger.handleInitialState(("W", "x"), opening, None)
    names = ["t", "seq", "kind", "quantity"]
    parts = [
        pd.DataFrame([(3, 3, "commit", 4.0), (2, 2, "reserve", 7.0)], columns=names),
        pd.DataFrame([(1, 1, "reserve", 4.0), (4, 4, None, 1.0), (5, 5, "reserve", None)], columns=names),
    ]
    out = pd.concat(ledger.handleInputRows(("W", "x"), iter(parts), None))
    # the second reserve is not covered once the first is applied
    assert out.values.tolist() == [["W", "x", 6, 0, 6, 2, 3]]
    assert ledger.cell.value == (True, 6, 0, 6, 2, 3)
