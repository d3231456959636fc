"""The log against the tables, by identity; stored rows against their rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.plans.single import one_row

# Event types this stage puts on the log itself, so the ledger
# of its input rightly has no row for them.
EXPECTED_ABSENT = {
    "order.scored": "output of the order stage, not its input",
    "order.approved": "terminal decision for fulfilment",
    "order.rejected": "terminal decision for fulfilment",
}


def _expected(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, why in EXPECTED_ABSENT.items():
        out = F.when(event_type == name, why).otherwise(out)
    return out


def expected_absent(records: DataFrame) -> DataFrame:
    """Log events that need no ledger row, with the reason."""
    return records.withColumn("reason", _expected(F.col("event_type"))).filter(
        F.col("event_type").isin(*EXPECTED_ABSENT)
    )


def to_reconcile(records: DataFrame) -> DataFrame:
    """Distinct ids that must have a ledger row; copies are combined map-side."""
    kept = ~F.col("event_type").isin(*EXPECTED_ABSENT)
    return records.filter(kept).groupBy("event_id").agg(F.min("order_id").alias("order_id"))


def missing(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events on the log that were never applied."""
    return to_reconcile(records).join(ledger.select("event_id"), "event_id", "left_anti")


def orphaned(records: DataFrame, ledger: DataFrame, topic: str, group: str) -> DataFrame:
    """Applied ids that are not on the log; only this topic's and group's."""
    own = ledger.filter((F.col("topic") == topic) & (F.col("consumer_group") == group))
    return own.select("event_id").distinct().join(
        records.select("event_id"), "event_id", "left_anti"
    )


def missing_orders(records: DataFrame, orders: DataFrame) -> DataFrame:
    published = records.select("order_id").distinct()
    return published.join(orders.select("order_id"), "order_id", "left_anti")


def duplicate_effects(effects: DataFrame) -> DataFrame:
    return (
        effects.groupBy("order_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )


def negative_stock(stock: DataFrame) -> DataFrame:
    return stock.filter(F.col("available") < 0)


def inconsistent_stock(stock: DataFrame) -> DataFrame:
    return stock.filter(F.col("available") != F.col("on_hand") - F.col("reserved"))


def totals(stock: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: oversold cells, units promised, orders scored."""
    cells = stock.agg(
        F.count(F.when(F.col("available") < 0, 1)).alias("oversells"),
        F.coalesce(F.sum("reserved"), F.lit(0)).alias("reserved_units"),
    )
    return one_row([cells, scores.agg(F.count(F.lit(1)).alias("scored"))])


def rows_breaking(df: DataFrame, check: str, broken: Column) -> DataFrame:
    return df.agg(
        F.lit(check).alias("check"),
        F.count(F.when(F.coalesce(broken, F.lit(False)), 1)).alias("violations"),
    )


def duplicates(df: DataFrame, check: str, keys: list[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rows_breaking(groups, check, F.col("_n") > 1)


def dangling(df: DataFrame, check: str, parents: DataFrame, key: str) -> DataFrame:
    lost = df.select(key).join(parents.select(key), key, "left_anti")
    return lost.agg(F.lit(check).alias("check"), F.count(F.lit(1)).alias("violations"))


def constraint_report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def report(
    records: DataFrame | None,
    ledger: DataFrame,
    stock: DataFrame,
    orders: DataFrame,
    topic: str,
    group: str,
) -> DataFrame:
    """One row: counts, named failures and whether the run passed.

    Without a readable log the run fails, as nothing was compared.
    """

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    parts = [
        single(negative_stock(stock), "negative_stock_rows"),
        single(inconsistent_stock(stock), "inconsistent_stock_rows"),
        single(orders, "orders_in_database"),
    ]
    if records is not None:
        parts += [
            single(to_reconcile(records), "on_log"),
            single(missing(records, ledger), "missing"),
            single(orphaned(records, ledger, topic, group), "orphaned"),
            single(expected_absent(records).select("event_id").distinct(), "expected_absent"),
        ]
    row = one_row(parts)
    if records is None:
        none = F.lit(None).cast("bigint")
        row = row.withColumns(
            {n: none for n in ("on_log", "missing", "orphaned", "expected_absent")}
        )
    n = F.col
    failures = F.array_compact(
        F.array(
            F.when(n("on_log").isNull(), "no readable event log"),
            F.when(n("missing") > 0, "events never applied"),
            F.when(n("orphaned") > 0, "effects without an event"),
            F.when(n("negative_stock_rows") > 0, "negative stock"),
            F.when(n("inconsistent_stock_rows") > 0, "inconsistent stock"),
            F.when((n("on_log") > 0) & (n("orders_in_database") == 0), "no orders at all"),
        )
    )
    return row.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def replayed_deliveries(deliveries: DataFrame) -> DataFrame:
    """Events seen after a restart and not before it. ``after``: the marker."""
    return (
        deliveries.groupBy("event_id")
        .agg(F.min(F.col("after").cast("int")).alias("_after"), F.count(F.lit(1)).alias("deliveries"))
        .filter(F.col("_after") == 1)
        .drop("_after")
    )


def repeated_deliveries(deliveries: DataFrame) -> DataFrame:
    return (
        deliveries.groupBy("event_id").agg(F.count(F.lit(1)).alias("deliveries")).filter("deliveries > 1")
    )


@dataclass(frozen=True)
class Budget:
    """Limits a run is judged by."""

    min_throughput_per_sec: float = 400.0
    min_end_to_end_per_sec: float = 0.0
    max_scoring_p95_ms: float = 200.0
    max_oversells: int = 0
    min_drain_per_sec: float = 20.0
    max_unaccounted_orders: int = 0


def budget_breaches(runs: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Add the named breaches of each run.

    A run that did not drain breaches that alone: its loss is undetermined, so
    neither the drain rate nor unaccounted orders are judged.
    """
    n = F.col
    timed_out = F.coalesce(n("drain_timed_out"), F.lit(False))
    breaches = F.array_compact(
        F.array(
            F.when(n("producer_per_sec") < budget.min_throughput_per_sec, "producer throughput"),
            F.when(n("end_to_end_per_sec") < budget.min_end_to_end_per_sec, "end-to-end throughput"),
            F.when(timed_out, "backlog not drained"),
            F.when(~timed_out & (n("drain_per_sec") < budget.min_drain_per_sec), "drain rate"),
            F.when(
                ~timed_out & (n("unaccounted_orders") > budget.max_unaccounted_orders),
                "unaccounted orders",
            ),
            F.when(n("scoring_p95_ms") > budget.max_scoring_p95_ms, "scoring p95"),
            F.when(n("oversells") > budget.max_oversells, "oversells"),
        )
    )
    return runs.withColumns(
        {
            "breaches": breaches,
            "loss_undetermined": timed_out,
        }
    )
