"""Table upserts: seed rows once, reset stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after inserting the incoming rows whose key is absent."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def reset_stock(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set incoming cells to ``on_hand``, nothing reserved, one version up.

    Both sides are unique on ``warehouse_id, sku``; new cells start at version 0.
    """
    old, new = existing.alias("old"), incoming.select("warehouse_id", "sku", "on_hand").alias("new")
    hit = F.col("new.on_hand").isNotNull()
    return old.join(new, ["warehouse_id", "sku"], "full").select(
        "warehouse_id",
        "sku",
        F.coalesce(F.col("new.on_hand"), F.col("old.on_hand")).alias("on_hand"),
        F.when(hit, 0).otherwise(F.col("old.reserved")).cast("bigint").alias("reserved"),
        F.when(hit, F.col("new.on_hand")).otherwise(F.col("old.available")).alias("available"),
        F.when(hit & F.col("old.version").isNotNull(), F.col("old.version") + 1)
        .when(hit, 0)
        .otherwise(F.col("old.version"))
        .cast("bigint")
        .alias("version"),
    )


def insert_stock(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-only seeding; a cell that is already there fails the job."""
    clash = F.raise_error(F.concat(F.lit("stock exists: "), F.col("warehouse_id"), F.col("sku")))
    checked = incoming.join(
        existing.select("warehouse_id", "sku", F.lit(True).alias("_there")),
        ["warehouse_id", "sku"],
        "left",
    )
    fresh = checked.select(
        "warehouse_id",
        "sku",
        F.when(F.col("_there").isNull(), F.col("on_hand")).otherwise(clash.cast("bigint")).alias(
            "on_hand"
        ),
    )
    return existing.unionByName(
        fresh.select(
            "warehouse_id",
            "sku",
            "on_hand",
            F.lit(0).cast("bigint").alias("reserved"),
            F.col("on_hand").alias("available"),
            F.lit(0).cast("bigint").alias("version"),
        )
    )


def stock_snapshot(stock: DataFrame) -> DataFrame:
    return stock.orderBy("warehouse_id", "sku")


def parquet_or_jdbc(spark, source: str, table: str | None = None, **options) -> DataFrame:
    """A stored table by Parquet path or JDBC url; both push filters down."""
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=table, **options).load()
    return spark.read.parquet(source)
