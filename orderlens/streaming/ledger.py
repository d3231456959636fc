"""The guarded stock ledger as keyed state: one cell, one small row of state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderlens.operators.ledger import CELL, step

_COLUMNS = [*CELL, "on_hand", "reserved", "available", "version", "refused"]
_OUT = "on_hand long, reserved long, available long, version long, refused long"


class GuardedLedger(StatefulProcessor):
    """Applies the movements of a cell and emits what they leave.

    Movements of a micro-batch go by (t, seq), micro-batches as they arrive. A cell
    without opening stock refuses all. State is five numbers, whatever the
    history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("cell", f"stocked boolean, {_OUT}")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for s in initialState.itertuples(index=False):
            self.cell.update((True, *map(int, (s.on_hand, s.reserved, s.available, s.version)), 0))

    def handleInputRows(  # noqa: N802
        self, key, rows: Iterator[pd.DataFrame], timerValues  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        stocked, on_hand, reserved, available, version, refused = self.cell.get() or (
            False, 0, 0, 0, 0, 0,
        )
        moves = pd.concat([r[["t", "seq", "kind", "quantity"]] for r in rows], ignore_index=True)
        moves = moves.assign(kind=moves["kind"].fillna(""), quantity=moves["quantity"].fillna(0).astype("int64"))
        moves = moves.sort_values(["t", "seq", "kind", "quantity"], kind="stable")
        if not stocked:
            refused += len(moves)
            moves = moves.iloc[:0]
        for kind, quantity in zip(moves["kind"].tolist(), moves["quantity"].tolist()):
            after = step(kind, quantity, reserved, available)
            if after is None:
                refused += 1
                continue
            on_hand -= quantity if kind == "commit" else 0
            (reserved, available), version = after, version + 1
        left = (on_hand, reserved, available, version, refused)
        self.cell.update((stocked, *left))
        yield pd.DataFrame([(*key, *left)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_ledger(movements: DataFrame, stock: DataFrame) -> DataFrame:
    """Each cell that a micro-batch moves, as its movements leave it.

    ``movements`` is a stream of ``warehouse_id, sku, kind, quantity, t, seq``,
    ``stock`` the table it starts from.
    """
    opening = stock.select(
        *CELL, *[stock[c].cast("bigint").alias(c) for c in ("on_hand", "reserved", "available", "version")]
    )
    return movements.groupBy(*CELL).transformWithStateInPandas(
        statefulProcessor=GuardedLedger(),
        outputStructType=f"warehouse_id string, sku string, {_OUT}",
        outputMode="Update",
        timeMode="None",
        initialState=opening.groupBy(*CELL),
    )
