"""Queries that run as streams over the test tables and end when caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog.prelude import LEDGER
from orderlens.catalog.registry import query
from orderlens.catalog.stock import opening_stock
from orderlens.functions.clock import add_seconds, epoch_micros
from orderlens.operators import history, scoring
from orderlens.plans.storage import fresh_path, stored
from orderlens.streaming import events, run
from orderlens.streaming.expiry import stream_expiry
from orderlens.streaming.history import history_events, stream_history, stream_history_in_order
from orderlens.streaming.ledger import stream_ledger


class _Streamed:
    """Reads one test table as a stream through the adapter's functions."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self._spark, self._table = spark, table
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        if name == f"{self._table}.parquet":
            return run.file_stream(self._spark, folder, name)
        return self._spark.read.parquet(path)

    def __getattr__(self, name: str):
        return getattr(self._spark, name)


@query(
    "stream_score",
    "SELECT order_id, round(score, 6) AS score, band FROM scr",
)
def stream_score(spark, sf_dir):
    """Orders scored from state; features and score are the batch functions."""
    orders = adapter.order_arrivals(_Streamed(spark, "orders"), sf_dir)
    # an order without lines is not scored, but its chargeback counts
    has_lines = adapter.baskets(spark, sf_dir).select("seq", F.lit(True).alias("has_lines"))
    past = stream_history(
        history_events(
            orders.join(has_lines, "seq", "left"),
            F.col("has_lines"),
            F.col("seq") % 50 == 0,
            add_seconds(F.col("received_at"), 3600),
        )
    )
    context = adapter.scoring_orders(spark, sf_dir).drop("customer_id")
    written = run.catch_up(past, "stream-score")
    scored = scoring.with_score(history.with_features(written.join(context, "seq")))
    return scored.select("order_id", F.round("score", 6).alias("score"), "band")


@query(
    "stream_history_ordered",
    """SELECT order_id, prior_orders, prior_cents, prior_bin_orders, bin_is_new, velocity_count,
         prior_chargeback_count, false AS late
       FROM hist WHERE t < (SELECT max(t) - 600 FROM (SELECT t FROM so UNION ALL SELECT t FROM cbk))""",
)
def stream_history_ordered(spark, sf_dir):
    """Orders that the watermark has passed, each after all older ones; a stream
    keeps the last ten minutes waiting."""
    orders = adapter.order_arrivals(_Streamed(spark, "orders"), sf_dir)
    # written once, as the batch that only moves the watermark joins them too
    has_lines = stored(
        adapter.baskets(spark, sf_dir).select("seq", F.lit(True).alias("has_lines")), "has-lines"
    )
    past = stream_history_in_order(
        history_events(
            orders.join(has_lines, "seq", "left"),
            F.col("has_lines"),
            F.col("seq") % 50 == 0,
            add_seconds(F.col("received_at"), 3600),
        ),
        "10 minutes",
    )
    return run.catch_up(past, "stream-history-ordered").select(
        F.concat(F.lit("O-"), F.col("seq").cast("string")).alias("order_id"),
        "prior_orders",
        "prior_cents",
        "prior_bin_orders",
        "bin_is_new",
        "velocity_count",
        "prior_chargeback_count",
        "late",
    )


@query("stream_dedup", "SELECT event_id, 1 AS kept FROM dlv GROUP BY event_id")
def stream_dedup(spark, sf_dir):
    records = adapter.deliveries(_Streamed(spark, "orders"), sf_dir).withColumn(
        "ts", adapter.from_epoch_seconds(F.lit(adapter.START) + F.col("t"))
    )
    kept = events.first_in_watermark(events.with_event_time(records, "ts", "10 minutes"))
    written = run.catch_up(kept.select("event_id"), "stream-dedup")
    return written.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("kept"))


@query(
    "stream_effects_once",
    """SELECT customer_id, count(DISTINCT event_id) AS effects, count(*) AS deliveries
       FROM dlv GROUP BY customer_id""",
)
def stream_effects_once(spark, sf_dir):
    """What each customer's events did, beside how often they were delivered."""
    records = adapter.deliveries(_Streamed(spark, "orders"), sf_dir).select("event_id", "customer_id")
    path = fresh_path(spark, "stream-effects")
    run.apply_once(
        records, "event_id", run.batch_writer(path), fresh_path(spark, "stream-effects-checkpoint")
    )
    did = spark.read.parquet(path).groupBy("customer_id").agg(F.count(F.lit(1)).alias("effects"))
    came = (
        adapter.deliveries(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("deliveries"))
    )
    return came.join(did, "customer_id")


@query(
    "stream_rates",
    """SELECT outcome, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS increase FROM req
       GROUP BY 1, 2 HAVING window_start + 3600 <= (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 600 FROM req)""",
)
def stream_rates(spark, sf_dir):
    """Windows the watermark has closed; the last open ones are not emitted."""
    rows = events.with_event_time(
        adapter.requests(_Streamed(spark, "events"), sf_dir), "ts", "10 minutes"
    )
    return run.catch_up(events.windowed_counts(rows, "1 hour", ["outcome"]), "stream-rates")


@query(
    "stream_expiry",
    """WITH ch AS (SELECT (o_orderkey * 7919) % 43200 + d AS t FROM orders, (VALUES (0, 0), (1, 300), (2, 400), (3, 200)) v(r, d)
         WHERE o_orderkey % 3 = 0 AND (r = 0 OR o_orderkey % 4 = r))
       SELECT reservation_id, (epoch(expires_at) * 1000)::BIGINT AS expired_at_ms FROM rsv
       WHERE seq % 4 = 0 AND epoch(expires_at) <= 1704067200 + (SELECT max(t) FROM ch) - 60""",
)
def stream_expiry_query(spark, sf_dir):
    """Each hold and, where one comes, its first commit or release."""
    holds = adapter.reservations(_Streamed(spark, "orders"), sf_dir)
    seq, created = F.col("seq"), F.col("created_at")
    delay = (
        F.when(seq % 4 == 1, 300).when(seq % 4 == 2, 400).when(seq % 4 == 3, 200)
    )

    def change(kind: str, at):
        return F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.floor(epoch_micros(at) / 1000).cast("bigint").alias("at_ms"),
            F.floor(epoch_micros(F.col("expires_at")) / 1000).cast("bigint").alias("until_ms"),
        )

    hold = change("hold", created)
    settle = change("settle", add_seconds(created, F.coalesce(delay, F.lit(0))))
    changes = F.when(delay.isNotNull(), F.array(hold, settle)).otherwise(F.array(hold))
    rows = events.with_event_time(
        holds.select("reservation_id", F.inline(changes)), "at", "1 minute"
    )
    return run.catch_up(stream_expiry(rows), "stream-expiry")


@query(
    "stream_ledger",
    f"""WITH RECURSIVE m AS (SELECT 'WH-' || lpad(CAST(1 + seq % 12 AS VARCHAR), 2, '0') AS warehouse_id, sku,
             quantity AS q, kind, (seq * 7919) % 43200 + 300 * c AS t, seq * 3 + c AS seq
           FROM rl, range(0, 3) r(c), LATERAL (SELECT CASE c WHEN 0 THEN 'reserve'
             WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN 'commit' WHEN seq % 3 = 0 THEN 'release' END
             ELSE CASE WHEN seq % 61 = 0 THEN 'release' END END AS kind) k WHERE kind IS NOT NULL), {LEDGER}
       SELECT warehouse_id, sku, coalesce(arg_max(h, n), 0) AS on_hand, coalesce(arg_max(r, n), 0) AS reserved,
         coalesce(arg_max(a, n), 0) AS available, max(v) AS version, max(x) AS refused
       FROM led GROUP BY warehouse_id, sku""",
)
def stream_ledger_query(spark, sf_dir):
    """Movements of the raw lines; each changed cell is written per batch."""
    lines = adapter.raw_lines(_Streamed(spark, "lineitem"), sf_dir)
    seq, copy = F.col("seq"), F.col("copy")
    kinds = F.array(
        F.lit("reserve"),
        F.when(seq % 2 == 0, "commit").when(seq % 3 == 0, "release"),
        F.when(seq % 61 == 0, "release"),
    )
    moves = (
        lines.select("seq", "sku", "quantity", F.posexplode(kinds).alias("copy", "kind"))
        .filter(F.col("kind").isNotNull())
        .select(
            adapter.warehouse_name(1 + seq % 12).alias("warehouse_id"),
            "sku",
            "kind",
            "quantity",
            ((seq * 7919) % 43200 + 300 * copy).alias("t"),
            (seq * 3 + copy).alias("seq"),
        )
    )
    path = fresh_path(spark, "stream-ledger")
    run.catch_up_batches(
        stream_ledger(moves, opening_stock(spark)),
        run.batch_writer(path),
        fresh_path(spark, "stream-ledger-checkpoint"),
        mode="update",
    )
    return run.latest_rows(path, spark, ["warehouse_id", "sku"])
