"""The retail test tables read as the order-event domain.

Only arithmetic on the given columns, so the same rows can be stated in plain
SQL. Every function reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.clock import from_epoch_seconds

START = 1_704_067_200  # 2024-01-01 00:00:00 UTC
SPAN = 43_200
CATALOGUE = 24
WAREHOUSES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sku_name(number: Column) -> Column:
    return F.concat(F.lit("SKU-"), F.lpad(number.cast("string"), 2, "0"))


def warehouse_name(number: Column) -> Column:
    return F.concat(F.lit("WH-"), F.lpad(number.cast("string"), 2, "0"))


def order_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows without their basket: who, when, how much."""
    key = F.col("o_orderkey")
    second = (key * 7919) % SPAN
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
        second.alias("t"),
        from_epoch_seconds(F.lit(START) + second).alias("received_at"),
        F.col("o_orderstatus").alias("source_status"),
        F.concat(
            F.lit("K-"), F.when(key % 11 == 0, key - 1).otherwise(key).cast("string")
        ).alias("idempotency_key"),
        (F.col("o_custkey") * 31 + (key % 9 == 0).cast("int")).cast("string").alias("card_bin"),
        F.when(key % 13 == 0, "SAVE10").alias("coupon_code"),
        (key % 20 == 0).alias("is_gift_card"),
    )


def order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with the four countries from the customer's nation."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("_n")
    )
    key, nation = F.col("seq"), F.col("_n")

    def country(number: Column) -> Column:
        return F.coalesce(F.lpad(number.cast("string"), 2, "0"), F.lit(""))

    return (
        order_arrivals(spark, sf_dir)
        .join(customers, "customer_id", "left")
        .withColumns(
            {
                "billing_country": country(nation),
                "shipping_country": country(
                    F.when(key % 10 == 0, (nation + 1) % 25).otherwise(nation)
                ),
                "card_country": country(
                    F.when(key % 17 == 0, (nation + 2) % 25).otherwise(nation)
                ),
                "ip_country": F.when(key % 41 == 0, "").otherwise(
                    country(F.when(key % 23 == 0, (nation + 3) % 25).otherwise(nation))
                ),
            }
        )
        .drop("_n")
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as they arrive: SKUs may repeat, prices may conflict."""
    sku = F.col("l_partkey") % CATALOGUE
    conflict = (F.col("l_orderkey") % 19 == 0) & (F.col("l_linenumber") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        sku_name(sku).alias("sku"),
        (1 + F.col("l_quantity").cast("int") % 3).alias("quantity"),
        (1000 + 37 * sku + conflict.cast("int")).cast("bigint").alias("unit_price_cents"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order and SKU with the summed quantity."""
    merged = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("seq"), (F.col("l_partkey") % CATALOGUE).alias("_sku")
        )
        .agg(F.sum(1 + F.col("l_quantity").cast("int") % 3).cast("int").alias("quantity"))
    )
    return merged.select(
        "seq",
        F.concat(F.lit("O-"), F.col("seq").cast("string")).alias("order_id"),
        sku_name(F.col("_sku")).alias("sku"),
        "quantity",
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the two basket numbers the features need.

    Grouped by order and SKU number first, so a giant order is combined before
    it is shuffled, and without building any SKU text.
    """
    merged = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("seq"), (F.col("l_partkey") % CATALOGUE).alias("_sku")
        )
        .agg(F.sum(1 + F.col("l_quantity").cast("int") % 3).alias("_q"))
    )
    return merged.groupBy("seq").agg(
        F.count(F.lit(1)).alias("distinct_skus"), F.sum("_q").alias("total_quantity")
    )


def scoring_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have at least one line, ready for features."""
    return order_contexts(spark, sf_dir).join(baskets(spark, sf_dir), "seq")


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chargeback per fiftieth order, an hour after it."""
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 50 == 0)
        .select(
            F.col("o_custkey").alias("customer_id"),
            key.alias("seq"),
            from_epoch_seconds(F.lit(START + 3600) + (key * 7919) % SPAN).alias("charged_at"),
        )
    )


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged lines with their order's arrival second ``t``, from the order key."""
    return lines(spark, sf_dir).withColumn("t", (F.col("seq") * 7919) % SPAN)


def stock(spark: SparkSession) -> DataFrame:
    """The 24-item catalogue's stock: 12 warehouses, one SKU stocked nowhere."""
    wh, sku = F.col("wh"), F.col("sku_no")
    cells = spark.range(WAREHOUSES * (CATALOGUE - 1)).select(
        (1 + F.col("id") % WAREHOUSES).alias("wh"),
        F.floor(F.col("id") / WAREHOUSES).alias("sku_no"),
    )
    return cells.filter((sku + wh) % 5 != 0).select(
        warehouse_name(wh).alias("warehouse_id"),
        sku_name(sku).alias("sku"),
        (150 + (sku * 13 + wh * 7) % 220).alias("available"),
    )


def part_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock ledger over all parts, three warehouses each, with some bad rows."""
    key, i = F.col("p_partkey"), F.col("i")
    on_hand = 20 + F.col("p_size") * 3 + i
    reserved = (key + i) % 10
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
        .select(
            warehouse_name(1 + (key * 5 + i * 7) % WAREHOUSES).alias("warehouse_id"),
            F.concat(F.lit("P-"), key.cast("string")).alias("sku"),
            F.when((key % 89 == 0) & (i == 0), 5).otherwise(on_hand).cast("bigint").alias("on_hand"),
            reserved.cast("bigint").alias("reserved"),
            F.when((key % 89 == 0) & (i == 0), -5)
            .when(key % 97 == 0, on_hand - reserved - 1)
            .otherwise(on_hand - reserved)
            .cast("bigint")
            .alias("available"),
            i.cast("bigint").alias("version"),
        )
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of the order topic; every seventh event arrives twice."""
    key, copy = F.col("o_orderkey"), F.col("copy")
    return (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            "o_custkey",
            F.explode(
                F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            ).alias("copy"),
        )
        .select(
            key.alias("event_id"),
            F.when(key.isNotNull(), "order-events").alias("topic"),
            F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
            F.when(key % 12 == 5, "order.scored")
            .when(key % 12 == 7, "order.approved")
            .otherwise("order.accepted")
            .alias("event_type"),
            (key % 6).cast("int").alias("partition"),
            ((key * 7919) % SPAN + 30 * copy).alias("t"),
            (key * 2 + copy).alias("tie"),
            copy.alias("copy"),
            F.col("o_custkey").alias("customer_id"),
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied events: some missing, two that no log has, some in progress."""
    key = F.col("event_id")
    applied = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderkey") % 101 != 0)
        .select(F.col("o_orderkey").alias("event_id"))
    )
    ghosts = spark.range(-2, 0).select(F.col("id").alias("event_id"))
    return applied.unionByName(ghosts).select(
        "event_id",
        F.when(key.isNotNull(), "order-events").alias("topic"),
        F.lit("order-processor").alias("consumer_group"),
        F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
        F.when(key % 37 == 0, "accepted").otherwise("scored").alias("effect"),
        (F.abs(key) * 7919 % SPAN + 5).alias("applied_t"),
    )


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds of every third order; half of them carry their lines."""
    key = F.col("o_orderkey")
    received = from_epoch_seconds(F.lit(START) + (key * 7919) % SPAN)
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 3 == 0)
        .select(
            key.alias("seq"),
            F.concat(F.lit("R-"), key.cast("string")).alias("reservation_id"),
            F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
            warehouse_name(1 + key % WAREHOUSES).alias("warehouse_id"),
            received.alias("created_at"),
            from_epoch_seconds(F.lit(START + 900) + (key * 7919) % SPAN).alias("expires_at"),
            F.when(key % 4 == 1, "committed")
            .when(key % 4 == 2, "released")
            .otherwise("held")
            .alias("state"),
        )
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit and release attempts on the holds; some come too late."""
    key = F.col("o_orderkey")

    def attempt(kind: str, delay: int):
        return F.struct(F.lit(kind).alias("transition"), F.lit(delay).alias("delay"))

    attempts = (
        F.when(key % 4 == 1, F.array(attempt("commit", 300), attempt("release", 600)))
        .when(key % 4 == 2, F.array(attempt("release", 400)))
        .when(key % 4 == 3, F.array(attempt("release", 500), attempt("commit", 200)))
        .otherwise(F.array().cast("array<struct<transition:string,delay:int>>"))
    )
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 3 == 0)
        .select("o_orderkey", F.inline(attempts))
        .select(
            F.concat(F.lit("R-"), key.cast("string")).alias("reservation_id"),
            "transition",
            ((key * 7919) % SPAN + F.col("delay")).alias("t"),
        )
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items of every sixth order in all four states."""
    key = F.col("o_orderkey")
    second = (key * 7919) % SPAN
    status = (
        F.when(key % 5 <= 1, "pending")
        .when(key % 5 == 2, "approved")
        .when(key % 5 == 3, "rejected")
        .otherwise("expired")
    )
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 6 == 0)
        .select(
            F.concat(F.lit("V-"), key.cast("string")).alias("review_id"),
            F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
            key.alias("seq"),
            status.alias("status"),
            from_epoch_seconds(F.lit(START) + second).alias("created_at"),
            from_epoch_seconds(F.lit(START + 3600) + second).alias("sla_deadline"),
            F.when((status != "pending") & (key % 210 != 18), F.lit("supervisor")).alias(
                "decided_by"
            ),
            F.when(status != "pending", from_epoch_seconds(F.lit(START + 1800) + second)).alias(
                "decided_at"
            ),
        )
    )


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision tasks for the review items; every fifth is contradicted later."""
    key, copy = F.col("o_orderkey"), F.col("copy")
    approve = (key % 3 != 0) != (copy == 1)
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 2 == 0)
        .select(
            "o_orderkey",
            F.explode(
                F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            ).alias("copy"),
        )
        .select(
            F.concat(F.lit("V-"), key.cast("string")).alias("review_id"),
            F.concat(F.lit("O-"), key.cast("string")).alias("order_id"),
            (key * 2 + copy).alias("seq"),
            F.when(key % 22 == 0, "expired")
            .when(approve, "approved")
            .otherwise("rejected")
            .alias("decision"),
            ((key * 7919) % SPAN + 600 + 600 * copy).alias("t"),
            F.when(copy == 1, "second reader").otherwise("supervisor").alias("decided_by"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as API requests: who, when, how slow, with what outcome."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_type").alias("outcome"),
        F.col("value").alias("latency_ms"),
        "props",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handler attempts of every event: one to three, some never succeed."""
    key = F.col("event_id")
    tries = 1 + key % 3
    return (
        table(spark, sf_dir, "events")
        .select("event_id", F.explode(F.sequence(F.lit(1), tries)).alias("attempt"))
        .select(
            key.alias("task_id"),
            F.when(key % 2 == 0, "reviews").otherwise("notifications").alias("queue"),
            (key % 6).cast("int").alias("partition"),
            key.alias("offset"),
            F.col("attempt").cast("int").alias("attempt"),
            ((F.col("attempt") == tries) & ~((key % 3 == 2) & (key % 11 == 0))).alias("ok"),
        )
    )
