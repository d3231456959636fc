"""De-duplication, windows and the stock ledger on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.clock import as_instant
from orderlens.operators import allocation, flow
from orderlens.plans.storage import pinned


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Add ``event_time``, an instant, and its watermark."""
    return stream.withColumn("event_time", as_instant(F.col(ts))).withWatermark("event_time", delay)


def first_in_watermark(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop copies that come within the watermark's delay. State is bounded by
    the delay; later copies are for the ledger to refuse."""
    return stream.dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, window: str, labels: list[str]) -> DataFrame:
    """Counts of tumbling windows, each emitted when the watermark passes it."""
    return (
        stream.groupBy(F.window("event_time", window), *labels)
        .agg(F.count(F.lit(1)).alias("increase"))
        .select(
            *labels,
            F.unix_seconds("window.start").alias("window_start"),
            "increase",
        )
    )


def allocation_writer(opening_stock: DataFrame, path: str):
    """Allocate each micro-batch against the stock the one before it left.

    Picks are as of the batch start. Both results of a batch are written to
    its own folder, so a repeated batch starts from the same stock and
    replaces itself.
    """

    def write(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        stock = (
            spark.read.parquet(f"{path}/stock/batch={batch_id - 1}")
            if batch_id > 0
            else opening_stock
        )
        folder = f"{path}/outcomes/batch={batch_id}"
        allocation.allocate(lines, stock).write.mode("overwrite").parquet(folder)
        outcomes = spark.read.parquet(folder)
        allocation.remaining_stock(stock, lines, outcomes).write.mode("overwrite").parquet(
            f"{path}/stock/batch={batch_id}"
        )

    return write


def decision_writer(opening_stock: DataFrame, path: str):
    """Approve or hold each micro-batch with the stock the one before it left.

    Rows are routed orders, each once, with ``t, seq`` and ``items`` (``sku,
    quantity``). Orders take their stock in turn, so decisions do not depend on
    where batches are cut as long as they come in order. A batch has two parts,
    ``decisions`` and ``stock``. It counts once its stock is written, as the next
    one starts from that; a repeated batch starts from the same stock and
    replaces both parts.
    """

    def write(routed: DataFrame, batch_id: int) -> None:
        spark = routed.sparkSession
        stock = (
            spark.read.parquet(f"{path}/stock/batch={batch_id - 1}") if batch_id > 0 else opening_stock
        )
        orders = pinned(routed)
        lines = orders.select("order_id", "t", "seq", F.inline("items"))
        folder = f"{path}/decisions/batch={batch_id}"
        flow.outcome_in_turn(orders.drop("items"), lines, stock).write.mode("overwrite").parquet(folder)
        won = F.col("status") == "reserved"
        granted = spark.read.parquet(folder).select("order_id", "warehouse_id", won.alias("reserved"))
        allocation.remaining_stock(stock, lines, granted).write.mode("overwrite").parquet(
            f"{path}/stock/batch={batch_id}"
        )

    return write
