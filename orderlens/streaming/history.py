"""Customer history as keyed state, so that a stream can score its orders.

The state of a customer is three sums, a chargeback count, the BINs seen (a map
beyond the first few) and the times inside the velocity window. Arrival order
rules: rows are applied in time order within a micro-batch, and a late order counts
what is there. Where the order of time must rule, rows wait for the watermark
(``OrderedHistory``), and many customers share one state.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderlens import schemas
from orderlens.functions.clock import MICROS, epoch_micros

_TYPES = {
    "seq": "long", "prior_orders": "long", "prior_cents": "long", "prior_cents_sq": "double",
    "prior_bin_orders": "long", "bin_is_new": "boolean", "velocity_count": "long", "prior_chargeback_count": "long",
}
_COLUMNS = [*_TYPES]
#: A row of ``CustomerHistory`` holds the views of many orders of a customer, a list a column.
_OUT = ", ".join(f"{c} array<{t}>" for c, t in _TYPES.items())
_EMITTED = Row(*_COLUMNS)
_EVENT = ["us", "kind", "seq", "cents", "bin"]
#: Most orders in one row.
_VIEWS = 10_000
#: BINs that stand beside the sums; further ones are entries of a map.
_FEW_BINS = 16

#: A row of ``OrderedHistory`` holds views as the bytes of an Arrow batch.
_ORDERED = _TYPES | {"late": "boolean"}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_VIEW = pa.schema([(c, _ARROW[t]) for c, t in _ORDERED.items()])
#: Groups of customers that share a state where rows wait for the watermark.
GROUPS = 2048
#: Most rows that a task deals to the groups at once, and most in one waiting piece.
_DEALT, _PIECE = 500_000, 10_000


class _Past:
    """What the earlier rows of a customer come to."""

    def __init__(self, held: tuple | None, bins, window: int) -> None:
        (
            self.orders, self.cents, squares, self.bin_orders, self.chargebacks, recent, few,
        ) = held or (0, 0, "0", 0, 0, [], [])
        self.squares, self.recent, self.few = int(squares), list(recent), list(few)
        self.held, self.bins, self.window = bool(held), bins, window

    def views(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Apply sorted rows, and emit each order's view before it.

        The times seen stay sorted, so a row finds its window by bisection, and
        what has left the window is dropped once per call.
        """
        few, recent = self.few, self.recent
        # each BIN of the batch is looked up in the state at most once
        known: dict[str, bool] = {}
        for us, kind, seq, amount, bin_ in rows:
            if kind == 1:
                self.chargebacks += 1 if self.orders else 0
                continue
            if bin_ and bin_ not in known:
                known[bin_] = bin_ in few or (
                    self.held and len(few) == _FEW_BINS and self.bins.containsKey((bin_,))
                )
            velocity = len(recent) - bisect_left(recent, us - self.window)
            is_new = bool(bin_) and not known[bin_]
            yield (
                seq, self.orders, self.cents, float(self.squares),
                self.bin_orders, is_new, velocity, self.chargebacks,
            )
            self.orders, self.cents, self.squares = self.orders + 1, self.cents + amount, self.squares + amount**2
            if bin_:
                self.bin_orders += 1
                if not known[bin_]:
                    if len(few) < _FEW_BINS:
                        few.append(bin_)
                    else:
                        self.bins.updateValue((bin_,), (True,))
                    known[bin_] = True
            insort(recent, us)
        if recent:
            del recent[: bisect_left(recent, recent[-1] - self.window)]

    def kept(self) -> tuple:
        return (
            self.orders, self.cents, str(self.squares), self.bin_orders, self.chargebacks, self.recent, self.few,
        )


def _many(views: Iterable[tuple]) -> Iterator[Iterator[tuple]]:
    """The columns of up to ``_VIEWS`` views at a time, as a row or a call of the
    state costs Python more than an order does."""
    views = iter(views)
    while rows := [*islice(views, _VIEWS)]:
        yield zip(*rows)


class CustomerHistory(StatefulProcessor):
    """Emits the history columns of each order of one customer."""

    def __init__(self, window_seconds: int = schemas.VELOCITY_SECONDS) -> None:
        self.window = window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState(
            "sums",
            "orders long, cents long, squares string, bin_orders long, chargebacks long, "
            "recent array<long>, few_bins array<string>",
        )
        self.bins = handle.getMapState("bins", "bin string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        past = _Past(self.sums.get(), self.bins, self.window)
        for columns in _many(past.views(sorted(r[-len(_EVENT):] for r in rows))):
            yield _EMITTED(*map(list, columns))
        if past.orders or past.held:
            self.sums.update(past.kept())

    def close(self) -> None:
        pass


class _BinsOf:
    """One customer's entries of a group's map of BINs."""

    def __init__(self, bins, customer) -> None:
        self.bins, self.customer = bins, customer

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return self.bins.containsKey((self.customer, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.bins.updateValue((self.customer, *key), value)


class OrderedHistory(StatefulProcessor):
    """The same in time order: rows wait until the watermark has passed them.

    Whatever batch a row comes in, it is applied after every older row of its
    customer that comes within the watermark's delay. A row that is older than one
    already applied cannot be put in order any more. It is applied at once, and
    emitted with ``late``.

    A key is a group of customers, as a call of the state costs Python more than a
    customer's rows do. Rows come and wait in pieces, each the Arrow bytes of many rows,
    and views leave so, as all that the timers of a task emit is held until the last
    one. A group keeps its customers' pasts as pickled dicts of those that
    changed; the newest counts, and before they hold twice the customers they become
    one. One timer a group wakes the oldest waiting row.
    """

    def __init__(
        self, schema: pa.Schema, customer_type: str, window_seconds: int = schemas.VELOCITY_SECONDS
    ) -> None:
        self.schema, self.customer_type = schema, customer_type
        self.window = window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "data binary")
        self.pasts = handle.getListState("pasts", "data binary")
        self.bins = handle.getMapState("bins", f"customer {self.customer_type}, bin string", "seen boolean")
        self.alarm = handle.getValueState("alarm", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = _table([r[-1] for r in rows], self.schema)
        if came["us"].null_count:
            raise ValueError("a row without a time cannot be put in order")
        pasts = self._pasts()
        if pasts[0]:
            fronts = {customer: front for customer, (front, _) in pasts[0].items()}
            late = [r[0] in fronts and r[1:4] < fronts[r[0]] for r in zip(*map(_values, came.columns))]
            if any(late):
                behind, came = came.filter(pa.array(late)), came.filter(pc.invert(pa.array(late)))
                yield from self._advance(behind, pasts, late=True)
        if came.num_rows:
            self.waiting.appendList([(p,) for p in _cut(came)[1]])
            self._wake(pc.min(came["us"]).as_py())

    def _pasts(self) -> tuple[dict, int]:
        """The front row and the sums of each customer, and how often any is stored."""
        pasts, stored = {}, 0
        for (data,) in self.pasts.get():
            some = pickle.loads(data)
            pasts |= some
            stored += len(some)
        return pasts, stored

    def _advance(self, rows: pa.Table, pasts: tuple[dict, int], late: bool) -> Iterator[Row]:
        """Apply the rows of each customer in order of time."""
        known, stored = pasts
        mine = defaultdict(list)
        customers, *events = map(_values, rows.columns)
        for customer, event in zip(customers, zip(*events)):
            mine[customer].append(event)
        changed = {}

        def views() -> Iterator[tuple]:
            for customer, own in mine.items():
                own.sort()
                front, held = known.get(customer, (None, None))
                past = _Past(held, _BinsOf(self.bins, customer), self.window)
                yield from past.views(own)
                changed[customer] = (front if late else own[-1][:3], past.kept())

        for columns in _many(views()):
            found = [pa.array(v, t) for v, t in zip(columns, _VIEW.types)]
            flags = pa.repeat(pa.scalar(late), len(found[0]))
            yield Row(views=pa.record_batch([*found, flags], schema=_VIEW).serialize().to_pybytes())
        known.update(changed)
        if stored + len(changed) > 2 * len(known):
            self.pasts.put([(pickle.dumps(known),)])
        else:
            self.pasts.appendValue((pickle.dumps(changed),))

    def _wake(self, us: int) -> None:
        """Wait for the first millisecond that is wholly after this time."""
        at, alarm = us // 1000 + 1, self.alarm.get()
        if alarm and alarm[0] <= at:
            return
        if alarm:
            self.handle.deleteTimer(alarm[0])
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = _table([data for (data,) in self.waiting.get()], self.schema)
        ripe = pc.less(rows["us"], passed * 1000)
        self.alarm.clear()
        left = rows.filter(pc.invert(ripe))
        if left.num_rows < rows.num_rows:
            yield from self._advance(rows.filter(ripe), self._pasts(), late=False)
        if left.num_rows:
            self.waiting.put([(p,) for p in _cut(left)[1]])
            self._wake(pc.min(left["us"]).as_py())
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _table(pieces: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in pieces], schema)


def _values(column: pa.ChunkedArray) -> list:
    """The values as Python's own; by way of numpy where that alters none."""
    whole = pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy().tolist() if whole or pa.types.is_string(column.type) else column.to_pylist()


def _cut(rows: pa.Table, starts: Iterable[int] = ()) -> tuple[list[int], list[bytes]]:
    """Rows in pieces: where each begins, and its bytes. A piece is no longer than
    ``_PIECE``, and each of ``starts`` begins one."""
    cuts = sorted({*starts, *range(0, rows.num_rows, _PIECE)})
    batches = rows.combine_chunks().to_batches()
    return cuts, [
        batches[0].slice(a, b - a).serialize().to_pybytes() for a, b in zip(cuts, [*cuts[1:], rows.num_rows])
    ]


def _deal(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of each group in pieces, in an Arrow job on the stream."""

    def dealt() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        groups = rows["group_no"].to_numpy()
        order = np.argsort(groups, kind="stable")
        groups = groups[order]
        starts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
        cuts, pieces = _cut(rows.select(schema.names).cast(schema).take(order), starts)
        return pa.record_batch({"group_no": groups[cuts], "piece": pa.array(pieces, pa.binary())})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _DEALT:
            yield dealt()
            held = []
    if any(b.num_rows for b in held):
        yield dealt()


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per order."""
    for batch in batches:
        yield from _table(batch["views"].to_pylist(), _VIEW).combine_chunks().to_batches()


def history_events(
    orders: DataFrame, is_scored: Column, charged_back: Column, charged_at: Column
) -> DataFrame:
    """Timeline rows of a stream of orders: the order itself where it is
    scored, and the chargeback it leads to where there is one."""

    def row(at: Column, kind: int, cents: Column, bin_: Column) -> Column:
        return F.struct(
            epoch_micros(at).alias("us"),
            F.lit(kind).cast("bigint").alias("kind"),
            cents.cast("bigint").alias("cents"),
            bin_.alias("bin"),
        )

    order = row(F.col("received_at"), 0, F.col("total_cents"), F.col("card_bin"))
    back = row(charged_at, 1, F.lit(0), F.lit(""))
    rows = F.array_compact(F.array(F.when(is_scored, order), F.when(charged_back, back)))
    return orders.select("customer_id", "seq", F.inline(rows))


def stream_history(events: DataFrame, window_seconds: int = schemas.VELOCITY_SECONDS) -> DataFrame:
    """``customer_id, seq`` and the history columns of every order."""
    views = events.select("customer_id", *_EVENT).groupBy("customer_id").transformWithState(
        statefulProcessor=CustomerHistory(window_seconds),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None",
    )
    return _a_row_per_order(views, _COLUMNS)


def _a_row_per_order(views: DataFrame, columns: list[str]) -> DataFrame:
    others = [c for c in views.columns if c not in columns]
    return views.select(*others, F.inline(F.arrays_zip(*columns)))


def stream_history_in_order(
    events: DataFrame,
    delay: str,
    window_seconds: int = schemas.VELOCITY_SECONDS,
    groups: int = GROUPS,
) -> DataFrame:
    """The same as in one batch for every row that comes within ``delay``.

    An order is emitted when the watermark has passed it, with ``late`` false. One
    that comes behind a row of its customer that was already applied counts what
    is there and has ``late`` true; none is dropped. State holds a customer's rows
    of the last ``delay``. Customers are dealt to ``groups``; a batch reads the state
    of the groups that it has rows for. The number of groups cannot change over a
    restart.
    """
    timed = events.withColumn("_event_time", F.timestamp_micros("us")).withWatermark("_event_time", delay)
    # without its time column the state does not drop what is behind the watermark
    rows = timed.select("customer_id", *_EVENT)
    schema, whose = to_arrow_schema(rows.schema), rows.schema["customer_id"].dataType.simpleString()
    dealt = rows.withColumn("group_no", F.pmod(F.hash("customer_id"), F.lit(groups))).mapInArrow(
        partial(_deal, schema=schema), "group_no int, piece binary"
    )
    views = dealt.groupBy("group_no").transformWithState(
        statefulProcessor=OrderedHistory(schema, whose, window_seconds),
        outputStructType="views binary",
        outputMode="Append",
        timeMode="EventTime",
    )
    return views.mapInArrow(_views, ", ".join(f"{c} {t}" for c, t in _ORDERED.items()))
