"""Queries over reconciliation, data rules, service levels and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog import risk
from orderlens.catalog.registry import query
from orderlens.catalog.stock import NOW
from orderlens.functions import clock
from orderlens.operators import metrics, reconcile
from orderlens.operators.metrics import LATENCY_BUCKETS, SCORE_BUCKETS

TOPIC, GROUP = "order-events", "order-processor"
_ABSENT = "('order.scored', 'order.approved', 'order.rejected')"
_MISSING = f"""SELECT DISTINCT event_id, order_id FROM dlv WHERE event_type NOT IN {_ABSENT}
  AND event_id NOT IN (SELECT event_id FROM lg)"""
_ORPHANED = "SELECT event_id FROM lg WHERE event_id NOT IN (SELECT event_id FROM dlv)"


@query(
    "recon_expected_absent",
    f"""SELECT event_id, copy, CASE event_type WHEN 'order.scored' THEN 'output of the order stage, not its input'
          ELSE 'terminal decision for fulfilment' END AS reason FROM dlv WHERE event_type IN {_ABSENT}""",
)
def recon_expected_absent(spark, sf_dir):
    return reconcile.expected_absent(adapter.deliveries(spark, sf_dir)).select(
        "event_id", "copy", "reason"
    )


@query("recon_missing", _MISSING)
def recon_missing(spark, sf_dir):
    return reconcile.missing(adapter.deliveries(spark, sf_dir), adapter.ledger(spark, sf_dir))


@query("recon_orphaned", _ORPHANED)
def recon_orphaned(spark, sf_dir):
    return reconcile.orphaned(
        adapter.deliveries(spark, sf_dir), adapter.ledger(spark, sf_dir), TOPIC, GROUP
    )


@query(
    "recon_missing_orders",
    "SELECT order_id FROM arr WHERE seq % 101 = 0",
)
def recon_missing_orders(spark, sf_dir):
    rows = adapter.order_arrivals(spark, sf_dir).filter(F.col("seq") % 101 != 0)
    return reconcile.missing_orders(adapter.deliveries(spark, sf_dir), rows)


@query("recon_duplicates", "SELECT order_id, count(*) AS copies FROM dlv GROUP BY 1 HAVING count(*) > 1")
def recon_duplicates(spark, sf_dir):
    return reconcile.duplicate_effects(adapter.deliveries(spark, sf_dir))


@query("dq_negative_stock", "SELECT warehouse_id, sku, available FROM pst WHERE available < 0")
def dq_negative_stock(spark, sf_dir):
    return reconcile.negative_stock(adapter.part_stock(spark, sf_dir)).select(
        "warehouse_id", "sku", "available"
    )


@query(
    "dq_inconsistent_stock",
    "SELECT warehouse_id, sku, on_hand, reserved, available FROM pst WHERE available <> on_hand - reserved",
)
def dq_inconsistent_stock(spark, sf_dir):
    return reconcile.inconsistent_stock(adapter.part_stock(spark, sf_dir)).drop("version")


@query(
    "recon_totals",
    """SELECT count(*) FILTER (available < 0) AS oversells, CAST(sum(reserved) AS BIGINT) AS reserved_units,
         (SELECT count(*) FROM bk) AS scored FROM pst""",
)
def recon_totals(spark, sf_dir):
    return reconcile.totals(adapter.part_stock(spark, sf_dir), adapter.baskets(spark, sf_dir))


@query(
    "dq_constraints",
    """SELECT 'stock not negative' AS "check", count(*) FILTER (on_hand < 0 OR reserved < 0 OR available < 0) AS violations FROM pst
       UNION ALL SELECT 'stock adds up', count(*) FILTER (available <> on_hand - reserved) FROM pst
       UNION ALL SELECT 'total not negative', count(*) FILTER (total_cents < 0) FROM arr
       UNION ALL SELECT 'quantity positive', count(*) FILTER (quantity <= 0) FROM rl
       UNION ALL SELECT 'one line per sku', count(*) FROM (SELECT 1 FROM rl GROUP BY order_id, sku HAVING count(*) > 1)
       UNION ALL SELECT 'one hold per warehouse', count(*) FROM (SELECT 1 FROM rsv GROUP BY order_id, warehouse_id HAVING count(*) > 1)
       UNION ALL SELECT 'event delivered once', count(*) FROM (SELECT 1 FROM dlv GROUP BY event_id HAVING count(*) > 1)
       UNION ALL SELECT 'one review per order', count(*) FROM (SELECT 1 FROM rev GROUP BY order_id HAVING count(*) > 1)
       UNION ALL SELECT 'decided has actor and time', count(*) FILTER (status <> 'pending' AND (decided_by IS NULL OR decided_at IS NULL)) FROM rev
       UNION ALL SELECT 'line has an order', count(*) FROM rl WHERE order_id NOT IN (SELECT order_id FROM arr)""",
)
def dq_constraints(spark, sf_dir):
    c = F.col
    stock = adapter.part_stock(spark, sf_dir)
    orders, lines = adapter.order_arrivals(spark, sf_dir), adapter.raw_lines(spark, sf_dir)
    items = adapter.reviews(spark, sf_dir)
    breaking, twice = reconcile.rows_breaking, reconcile.duplicates
    return reconcile.constraint_report(
        [
            breaking(
                stock,
                "stock not negative",
                (c("on_hand") < 0) | (c("reserved") < 0) | (c("available") < 0),
            ),
            breaking(stock, "stock adds up", c("available") != c("on_hand") - c("reserved")),
            breaking(orders, "total not negative", c("total_cents") < 0),
            breaking(lines, "quantity positive", c("quantity") <= 0),
            twice(lines, "one line per sku", ["order_id", "sku"]),
            twice(
                adapter.reservations(spark, sf_dir),
                "one hold per warehouse",
                ["order_id", "warehouse_id"],
            ),
            twice(adapter.deliveries(spark, sf_dir), "event delivered once", ["event_id"]),
            twice(items, "one review per order", ["order_id"]),
            breaking(
                items,
                "decided has actor and time",
                (c("status") != "pending") & (c("decided_by").isNull() | c("decided_at").isNull()),
            ),
            reconcile.dangling(lines, "line has an order", orders, "order_id"),
        ]
    )


@query(
    "recon_report",
    f"""SELECT *, concat_ws(',', CASE WHEN missing > 0 THEN 'events never applied' END,
          CASE WHEN orphaned > 0 THEN 'effects without an event' END, CASE WHEN negative_stock_rows > 0 THEN 'negative stock' END,
          CASE WHEN inconsistent_stock_rows > 0 THEN 'inconsistent stock' END) AS failures, false AS passed
        FROM (SELECT (SELECT count(*) FROM pst WHERE available < 0) AS negative_stock_rows,
          (SELECT count(*) FROM pst WHERE available <> on_hand - reserved) AS inconsistent_stock_rows,
          (SELECT count(*) FROM arr) AS orders_in_database,
          (SELECT count(DISTINCT event_id) FROM dlv WHERE event_type NOT IN {_ABSENT}) AS on_log,
          (SELECT count(*) FROM ({_MISSING})) AS missing, (SELECT count(*) FROM ({_ORPHANED})) AS orphaned,
          (SELECT count(DISTINCT event_id) FROM dlv WHERE event_type IN {_ABSENT}) AS expected_absent)""",
)
def recon_report(spark, sf_dir):
    return reconcile.report(
        adapter.deliveries(spark, sf_dir),
        adapter.ledger(spark, sf_dir),
        adapter.part_stock(spark, sf_dir),
        adapter.order_arrivals(spark, sf_dir),
        TOPIC,
        GROUP,
    ).withColumn("failures", F.array_join("failures", ","))


@query(
    "deliveries_replayed",
    """SELECT event_id, count(*) AS deliveries FROM dlv GROUP BY event_id HAVING min(t) >= 20000""",
)
def deliveries_replayed(spark, sf_dir):
    return reconcile.replayed_deliveries(
        adapter.deliveries(spark, sf_dir).withColumn("after", F.col("t") >= 20000)
    )


@query(
    "deliveries_repeated",
    "SELECT event_id, count(*) AS deliveries FROM dlv GROUP BY event_id HAVING count(*) > 1",
)
def deliveries_repeated(spark, sf_dir):
    return reconcile.repeated_deliveries(adapter.deliveries(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split into fifty runs, each with its measured numbers."""
    seq = F.col("seq")
    n = F.count(F.lit(1)).cast("double")
    return (
        adapter.order_arrivals(spark, sf_dir)
        .groupBy((F.col("customer_id") % 50).alias("run"))
        .agg(
            (n * 1.4).alias("producer_per_sec"),
            (n / 2.0).alias("end_to_end_per_sec"),
            (n / 14.0).alias("drain_per_sec"),
            F.count(F.when(seq % 1009 == 0, 1)).alias("unaccounted_orders"),
            (F.max("total_cents") % 300).cast("double").alias("scoring_p95_ms"),
            F.count(F.when(seq % 997 == 0, 1)).alias("oversells"),
        )
        .withColumn("drain_timed_out", F.col("run") % 7 == 0)
    )


@query(
    "slo_breaches",
    """SELECT run, run % 7 = 0 AS loss_undetermined, concat_ws(',',
         CASE WHEN n * 1.4::DOUBLE < 400 THEN 'producer throughput' END,
         CASE WHEN run % 7 = 0 THEN 'backlog not drained' END,
         CASE WHEN run % 7 <> 0 AND n / 14.0::DOUBLE < 20 THEN 'drain rate' END,
         CASE WHEN run % 7 <> 0 AND lost > 0 THEN 'unaccounted orders' END,
         CASE WHEN p95 > 200 THEN 'scoring p95' END, CASE WHEN over > 0 THEN 'oversells' END) AS breaches
       FROM (SELECT customer_id % 50 AS run, count(*)::DOUBLE AS n, count(*) FILTER (seq % 1009 = 0) AS lost,
               max(total_cents) % 300 AS p95, count(*) FILTER (seq % 997 = 0) AS over FROM arr GROUP BY 1)""",
)
def slo_breaches(spark, sf_dir):
    return reconcile.budget_breaches(runs(spark, sf_dir)).select(
        "run", "loss_undetermined", F.array_join("breaches", ",").alias("breaches")
    )


@query(
    "counter_by_label",
    "SELECT outcome, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_start, count(*) AS total FROM req GROUP BY 1, 2",
)
def counter_by_label(spark, sf_dir):
    day = F.floor(clock.epoch_seconds(F.col("ts")) / 86400) * 86400
    rows = adapter.requests(spark, sf_dir).withColumn("day_start", day.cast("bigint"))
    return metrics.counters(rows, ["outcome", "day_start"])


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BUCKETS)
_HIST = f"""SELECT outcome, le, count(*) FILTER (le IS NULL OR latency_ms / 1000.0::DOUBLE <= le) AS cumulative
  FROM req, (VALUES {_BOUNDS}, (NULL)) b(le) GROUP BY outcome, le"""


def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("latency_ms") / F.lit(1000.0)
    return metrics.histogram(
        adapter.requests(spark, sf_dir), seconds, LATENCY_BUCKETS, ["outcome"]
    )


@query("latency_histogram", _HIST)
def latency_histogram(spark, sf_dir):
    return latency_buckets(spark, sf_dir)


_SCORE_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in SCORE_BUCKETS)


@query(
    "score_histogram",
    f"""SELECT le, count(*) FILTER (le IS NULL OR score <= le) AS cumulative
        FROM (SELECT round(score, 9) AS score FROM scr), (VALUES {_SCORE_BOUNDS}, (NULL)) b(le) GROUP BY le""",
)
def score_histogram(spark, sf_dir):
    return metrics.histogram(
        risk.scored(spark, sf_dir).select("score"), F.round("score", 9), SCORE_BUCKETS
    )


_FRACTIONS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


@query(
    "latency_bucket_percentiles",
    f"""WITH h AS ({_HIST}), n AS (SELECT outcome, max(cumulative) AS n FROM h WHERE le IS NOT NULL GROUP BY 1)
        SELECT outcome, n AS observations, min(le) FILTER (cumulative >= 0.5::DOUBLE * n) AS p50,
          min(le) FILTER (cumulative >= 0.95::DOUBLE * n) AS p95, min(le) FILTER (cumulative >= 0.99::DOUBLE * n) AS p99
        FROM h JOIN n USING (outcome) GROUP BY outcome, n""",
)
def latency_bucket_percentiles(spark, sf_dir):
    return metrics.bucket_percentiles(latency_buckets(spark, sf_dir), _FRACTIONS, ["outcome"])


@query(
    "latency_percentiles",
    """WITH r AS (SELECT outcome, latency_ms, row_number() OVER (PARTITION BY outcome ORDER BY latency_ms, seq) AS i,
           count(*) OVER (PARTITION BY outcome) AS n FROM req)
       SELECT outcome, n AS count, max(latency_ms) AS max, round(avg(latency_ms), 6) AS mean,
         max(latency_ms) FILTER (i = greatest(1, least(n, round_even(0.5::DOUBLE * n, 0)))) AS p50,
         max(latency_ms) FILTER (i = greatest(1, least(n, round_even(0.95::DOUBLE * n, 0)))) AS p95,
         max(latency_ms) FILTER (i = greatest(1, least(n, round_even(0.99::DOUBLE * n, 0)))) AS p99
       FROM r GROUP BY outcome, n""",
)
def latency_percentiles(spark, sf_dir):
    return metrics.nearest_rank(
        adapter.requests(spark, sf_dir), "latency_ms", _FRACTIONS, ["outcome"]
    ).withColumn("mean", F.round("mean", 6))


@query(
    "latency_interp_quantile",
    f"""WITH h AS ({_HIST}), n AS (SELECT outcome, max(cumulative) AS n FROM h GROUP BY 1),
        w AS (SELECT outcome, le, cumulative, coalesce(lag(le) OVER o, 0.0::DOUBLE) AS le0,
                coalesce(lag(cumulative) OVER o, 0) AS c0 FROM h WHERE le IS NOT NULL
              WINDOW o AS (PARTITION BY outcome ORDER BY le)),
        q AS (SELECT outcome, f, min(CASE WHEN cumulative >= f * n THEN le END) AS hit, max(le) AS last
              FROM w JOIN n USING (outcome), (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) v(f) GROUP BY 1, 2)
        SELECT q.outcome,
          round(max(CASE WHEN q.f = 0.5 THEN le0 + (le - le0) * (q.f * n - c0) / (cumulative - c0) END), 9) AS p50,
          round(max(CASE WHEN q.f = 0.95 THEN le0 + (le - le0) * (q.f * n - c0) / (cumulative - c0) END), 9) AS p95
        FROM q JOIN w ON w.outcome = q.outcome AND w.le = q.hit JOIN n ON n.outcome = q.outcome GROUP BY 1""",
)
def latency_interp_quantile(spark, sf_dir):
    out = metrics.interpolated_quantiles(
        latency_buckets(spark, sf_dir), {"p50": 0.50, "p95": 0.95}, ["outcome"]
    )
    return out.withColumns({"p50": F.round("p50", 9), "p95": F.round("p95", 9)})


@query(
    "event_rates",
    """SELECT outcome, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS increase,
         round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM req GROUP BY 1, 2""",
)
def event_rates(spark, sf_dir):
    return metrics.rates(adapter.requests(spark, sf_dir), ["outcome"], 3600).withColumn(
        "per_second", F.round("per_second", 9)
    )


@query(
    "fraud_rate_by_window",
    """SELECT CAST(1704067200 + floor(t / 3600) * 3600 AS BIGINT) AS window_start, count(*) FILTER (band = 'high') AS matching,
         count(*) AS total, round(count(*) FILTER (band = 'high') / greatest(count(*)::DOUBLE, 0.001), 6) AS ratio
       FROM scr GROUP BY 1""",
)
def fraud_rate_by_window(spark, sf_dir):
    scored = risk.scored(spark, sf_dir).withColumn("ts", F.col("received_at"))
    return metrics.ratio_by_window(scored, F.col("band") == "high", 3600).withColumn(
        "ratio", F.round("ratio", 6)
    )


@query(
    "alerts_sustained",
    """WITH d AS (SELECT outcome, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS w, count(*) AS n FROM req GROUP BY 1, 2),
       f AS (SELECT d.*, w - 86400 * row_number() OVER (PARTITION BY outcome ORDER BY w) AS island
             FROM d JOIN (SELECT outcome, avg(n) AS a FROM d GROUP BY 1) USING (outcome) WHERE n > a)
       SELECT outcome, min(w) AS started, max(w) + 86400 AS ended, max(w) + 86400 - min(w) AS held_seconds
       FROM f GROUP BY outcome, island HAVING max(w) + 86400 - min(w) >= 2 * 86400""",
)
def alerts_sustained(spark, sf_dir):
    """Two days or more above the label's own daily mean."""
    daily = metrics.rates(adapter.requests(spark, sf_dir), ["outcome"], 86400)
    usual = daily.groupBy("outcome").agg(F.avg("increase").alias("usual"))
    return metrics.sustained_alerts(
        daily.join(usual, "outcome"),
        F.col("increase") > F.col("usual"),
        ["outcome"],
        86400,
        2 * 86400,
    ).select("outcome", "started", "ended", "held_seconds")


@query(
    "heartbeat_gaps",
    """SELECT outcome, epoch_us(ts) AS silent_from_us, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 6) AS gap_seconds
       FROM (SELECT outcome, ts, lead(ts) OVER (PARTITION BY outcome ORDER BY ts) AS nxt FROM req)
       WHERE epoch_us(nxt) - epoch_us(ts) > 300000000""",
)
def heartbeat_gaps(spark, sf_dir):
    return metrics.heartbeat_gaps(adapter.requests(spark, sf_dir), ["outcome"]).withColumn(
        "gap_seconds", F.round("gap_seconds", 6)
    )


@query(
    "throughput_rates",
    """WITH r AS (SELECT customer_id % 4 AS run, t AS p, t + 5 + seq % 600 AS h FROM arr),
       b AS (SELECT run, count(*) AS events, min(p) AS lo, max(p) AS hi, max(h) AS done FROM r GROUP BY run)
       SELECT run, events, count(*) FILTER (h > hi) AS drained, round(events / (hi - lo)::DOUBLE, 6) AS producer_per_sec,
         round(count(*) FILTER (h > hi) / (done - hi)::DOUBLE, 6) AS drain_per_sec,
         round(events / (done - lo)::DOUBLE, 6) AS end_to_end_per_sec
       FROM r JOIN b USING (run) GROUP BY run, events, lo, hi, done""",
)
def throughput_rates(spark, sf_dir):
    rows = adapter.order_arrivals(spark, sf_dir).select(
        (F.col("customer_id") % 4).alias("run"),
        F.col("t").alias("published_t"),
        (F.col("t") + 5 + F.col("seq") % 600).alias("handled_t"),
    )
    out = metrics.throughput(rows)
    rates = ("producer_per_sec", "drain_per_sec", "end_to_end_per_sec")
    return out.withColumns({n: F.round(n, 6) for n in rates})


@query(
    "metric_totals",
    """SELECT metric, CAST(sum(n) AS BIGINT) AS total, count(*) AS series FROM (
         SELECT 'deliveries' AS metric, event_type AS label, count(*) AS n FROM dlv GROUP BY 2
         UNION ALL SELECT 'requests', outcome, count(*) FROM req GROUP BY 2
         UNION ALL SELECT 'effects', effect, count(*) FROM lg GROUP BY 2) GROUP BY metric""",
)
def metric_totals(spark, sf_dir):
    parts = [
        (adapter.deliveries(spark, sf_dir), "deliveries", "event_type"),
        (adapter.requests(spark, sf_dir), "requests", "outcome"),
        (adapter.ledger(spark, sf_dir), "effects", "effect"),
    ]
    tagged = [
        metrics.counters(df.select(F.col(label).alias("label")), ["label"]).withColumn(
            "metric", F.lit(name)
        )
        for df, name, label in parts
    ]
    return metrics.metric_totals(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))


@query(
    "iso_timestamps",
    """SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, ts AS from_z, ts AS from_offset, ts AS from_naive,
         ts - INTERVAL 2 HOUR AS from_plus_two, CAST(NULL AS TIMESTAMP) AS from_text FROM req""",
)
def iso_timestamps(spark, sf_dir):
    iso = clock.iso_utc(F.col("ts"))
    naive = F.regexp_replace(iso, "Z$", "")
    return adapter.requests(spark, sf_dir).select(
        "seq",
        iso.alias("iso"),
        clock.parse_iso_utc(iso).alias("from_z"),
        clock.parse_iso_utc(F.concat(naive, F.lit("+00:00"))).alias("from_offset"),
        clock.parse_iso_utc(naive).alias("from_naive"),
        clock.parse_iso_utc(F.concat(naive, F.lit("+02:00"))).alias("from_plus_two"),
        clock.parse_iso_utc(F.concat(F.lit("at "), naive)).alias("from_text"),
    )


@query(
    "order_age_seconds",
    f"""SELECT order_id, CASE WHEN seq % 9 = 0 THEN 0.0::DOUBLE
          ELSE (epoch_us(TIMESTAMP '{NOW}') - epoch_us(received_at)) / 1e6::DOUBLE END AS age_seconds FROM arr""",
)
def order_age_seconds(spark, sf_dir):
    when = F.when(F.col("seq") % 9 != 0, F.col("received_at"))
    return adapter.order_arrivals(spark, sf_dir).select(
        "order_id", clock.age_seconds(when, clock.ntz(NOW)).alias("age_seconds")
    )


