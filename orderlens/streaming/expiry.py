"""Holds that lapse by themselves: an event-time timer per reservation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "reservation_id string, expired_at_ms long"


class HoldExpiry(StatefulProcessor):
    """Waits for a hold's end; a commit or release before it settles the hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.deadline.get()
        deadline = held[0] if held else None
        for at, kind, until in sorted((r.at_ms, r.kind, r.until_ms) for r in rows):
            if kind == "hold":
                deadline = until if deadline is None else deadline
            elif deadline is not None and at <= deadline:
                deadline = None
                break
        if held and held[0] != deadline:
            self.handle.deleteTimer(held[0])
        if deadline is None:
            self.deadline.clear()
        elif not held or held[0] != deadline:
            self.deadline.update((deadline,))
            self.handle.registerTimer(deadline)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.deadline.clear()
        yield Row(reservation_id=key[0], expired_at_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def stream_expiry(changes: DataFrame) -> DataFrame:
    """Expired holds of a watermarked stream of hold and settle events.

    ``changes``: ``reservation_id, kind, at_ms, until_ms`` and an event-time
    column with a watermark.
    """
    return changes.groupBy("reservation_id").transformWithState(
        statefulProcessor=HoldExpiry(),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )
