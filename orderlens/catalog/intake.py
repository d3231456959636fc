"""Queries over the log, seeding, validation, de-duplication and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog.registry import query
from orderlens.functions.clock import from_epoch_seconds
from orderlens.operators import delivery, validation
from orderlens.plans.storage import fresh_path
from orderlens.sources import json_array, log, tables
from orderlens.sources.topic import Topic
from orderlens.streaming.run import batch_writer

START = adapter.START
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds({})"
_ISO = "strftime(" + _AT + ", '%Y-%m-%dT%H:%M:%S') || '.000000Z'"


def offset_log(spark, sf_dir):
    return log.assign_offsets(adapter.deliveries(spark, sf_dir), "t", "tie")


@query(
    "log_assign_offsets",
    'SELECT topic, order_id, event_id, copy, partition, "offset" FROM olog',
)
def log_assign_offsets(spark, sf_dir):
    return offset_log(spark, sf_dir).select(
        "topic", "order_id", "event_id", "copy", "partition", "offset"
    )


@query(
    "log_replay",
    'SELECT partition, "offset", event_id, event_type FROM olog WHERE "offset" >= 100',
)
def log_replay(spark, sf_dir):
    return log.replay(offset_log(spark, sf_dir), 100).select(
        "partition", "offset", "event_id", "event_type"
    )


# CRC-32 bit by bit; order ids are ASCII
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, len(order_id) + 1), lambda i: ascii(order_id[i])::BIGINT)), lambda c, b: {_CRC_BYTE}))"""


@query(
    "log_partition",
    f"SELECT order_id, CAST({_CRC} % 6 AS INTEGER) AS partition FROM (SELECT 'O-' || o_orderkey AS order_id FROM orders)",
)
def log_partition(spark, sf_dir):
    return adapter.order_arrivals(spark, sf_dir).select(
        "order_id", log.partition_for(F.col("order_id")).alias("partition")
    )


@query(
    "log_end_offsets",
    'SELECT topic, partition, max("offset") + 1 AS end_offset FROM olog GROUP BY topic, partition',
)
def log_end_offsets(spark, sf_dir):
    return log.end_offsets(offset_log(spark, sf_dir))


def commits(records):
    """Two groups that stopped at different times; one skipped a partition."""
    reached = records.select(
        "topic",
        "partition",
        "offset",
        "t",
        F.explode(F.array(F.lit("order-processor"), F.lit("audit"))).alias("consumer_group"),
    ).filter(
        F.when(F.col("consumer_group") == "audit", (F.col("t") < 20000) & (F.col("partition") != 3))
        .otherwise(F.col("t") < 40000)
    )
    return reached.groupBy("consumer_group", "topic", "partition").agg(
        (F.max("offset") + 1).alias("committed")
    )


_LAG = """
  WITH ends AS (SELECT topic, partition, max("offset") + 1 AS e FROM olog GROUP BY ALL),
  cm AS (SELECT g, partition, max("offset") + 1 AS c FROM olog, (VALUES ('order-processor'), ('audit')) v(g)
         WHERE CASE WHEN g = 'audit' THEN t < 20000 AND partition <> 3 ELSE t < 40000 END GROUP BY ALL),
  lags AS (SELECT g AS consumer_group, topic, ends.partition, greatest(0, e - coalesce(c, 0)) AS lag
           FROM ends CROSS JOIN (VALUES ('order-processor'), ('audit')) v(g)
           LEFT JOIN cm USING (g, partition))"""


@query(
    "log_lag",
    _LAG + " SELECT consumer_group, topic, CAST(sum(lag) AS BIGINT) AS lag FROM lags GROUP BY ALL",
)
def log_lag(spark, sf_dir):
    records = offset_log(spark, sf_dir)
    return log.group_lag(log.end_offsets(records), commits(records))


@query(
    "lag_by_group",
    _LAG + " SELECT consumer_group, topic, max(lag) AS max_lag FROM lags GROUP BY ALL",
)
def lag_by_group(spark, sf_dir):
    records = offset_log(spark, sf_dir)
    return (
        log.partition_lag(log.end_offsets(records), commits(records))
        .groupBy("consumer_group", "topic")
        .agg(F.max("lag").alias("max_lag"))
    )


def _topic(spark, sf_dir):
    """The delivered events as a topic of two appends, cut at one time."""
    topic = Topic(spark, fresh_path(spark, "topic"), "order-events")
    records = adapter.deliveries(spark, sf_dir).drop("topic")
    topic.append(records.filter(F.col("t") < 20000), "t", "tie")
    return topic, records.filter(F.col("t") >= 20000)


@query(
    "log_subscribe",
    'SELECT partition, "offset", event_id, event_type FROM olog',
)
def log_subscribe(spark, sf_dir):
    """What a group handled that stopped, came back after more was appended, and
    went on from its committed offsets."""
    topic, more = _topic(spark, sf_dir)
    path = fresh_path(spark, "subscribed")
    topic.consume("order-processor", batch_writer(path), limit=20_000, batches=1)
    topic.append(more, "t", "tie")
    topic.consume("order-processor", batch_writer(path), limit=20_000)
    return spark.read.parquet(path).select("partition", "offset", "event_id", "event_type")


@query(
    "log_subscribe_lag",
    """SELECT g AS consumer_group, topic, CAST(count(*) FILTER (g = 'idle' OR t >= 20000) AS BIGINT) AS lag
       FROM olog, (VALUES ('order-processor'), ('idle')) v(g) GROUP BY ALL""",
)
def log_subscribe_lag(spark, sf_dir):
    """One group caught up before the second append, the other never began."""
    topic, more = _topic(spark, sf_dir)
    topic.consume("order-processor", lambda records, number: None)
    topic.append(more, "t", "tie")
    groups = spark.createDataFrame(
        [("order-processor", topic.name), ("idle", topic.name)], "consumer_group string, topic string"
    )
    committed = topic.committed_offsets("order-processor", "idle")
    return log.group_lag(topic.end_offsets(), committed, groups)


def envelopes(spark, sf_dir):
    """Delivered events as envelope columns and their JSON text."""
    base = adapter.deliveries(spark, sf_dir).withColumns(
        {
            "occurred_at": from_epoch_seconds(F.lit(START) + F.col("t")),
            "correlation_id": F.lit(None).cast("string"),
            "offset": F.lit(None).cast("bigint"),
            "partition": F.lit(None).cast("int"),
        }
    )
    payload = F.struct("order_id", F.col("customer_id").cast("string").alias("customer_id"))
    return base.withColumn("wire", log.envelope_json(payload))


_WIRE = (
    """'{"event_id":"' || event_id || '","event_type":"' || event_type || '","occurred_at":"' || """
    + _ISO.format("t")
    + """ || '","correlation_id":"' || order_id || '","order_id":"' || order_id ||
     '","offset":null,"partition":null,"schema_version":1,"payload":{"order_id":"' || order_id ||
     '","customer_id":"' || customer_id || '"}}'"""
)


@query("envelope_encode", f"SELECT event_id, copy, {_WIRE} AS wire FROM dlv")
def envelope_encode(spark, sf_dir):
    return envelopes(spark, sf_dir).select("event_id", "copy", "wire")


def _export(frame):
    return log.export_line(F.col("topic"), F.col("order_id"), F.col("wire"))


@query(
    "log_export",
    f"""SELECT event_id, copy, '{{"topic":"order-events","key":"' || order_id || '","payload":"' ||
        to_base64(encode({_WIRE})) || '"}}' AS line FROM dlv""",
)
def log_export(spark, sf_dir):
    frame = envelopes(spark, sf_dir)
    return frame.select("event_id", "copy", _export(frame).alias("line"))


@query(
    "envelope_decode",
    f"""SELECT tie, CASE WHEN tie % 50 = 1 THEN NULL WHEN tie % 50 = 3 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
         CASE WHEN tie % 50 = 1 THEN NULL WHEN tie % 50 = 5 THEN 'order.lost' ELSE event_type END AS event_type,
         CASE WHEN tie % 50 IN (1, 7) THEN NULL ELSE {_AT.format('t')} END AS occurred_at,
         CASE WHEN tie % 50 = 1 THEN NULL ELSE order_id END AS order_id,
         CASE tie % 50 WHEN 1 THEN 'not a JSON object' WHEN 3 THEN 'no event_id'
           WHEN 5 THEN 'unknown event_type' WHEN 7 THEN 'bad occurred_at' END AS reject_reason
       FROM (SELECT * EXCLUDE (tie), seq AS tie FROM (SELECT *, event_id * 3 + copy AS seq FROM dlv))""",
)
def envelope_decode(spark, sf_dir):
    base = envelopes(spark, sf_dir).withColumn("tie", F.col("event_id") * 3 + F.col("copy"))
    wire, fault = F.col("wire"), F.col("tie") % 50
    broken = (
        F.when(fault == 1, F.substring(wire, 1, 20))
        .when(fault == 3, F.regexp_replace(wire, '"event_id":"[^"]*"', '"event_id":""'))
        .when(fault == 5, F.regexp_replace(wire, '"event_type":"[^"]*"', '"event_type":"order.lost"'))
        .when(fault == 7, F.regexp_replace(wire, '"occurred_at":"[^"]*"', '"occurred_at":"soon"'))
        .otherwise(wire)
    )
    return log.decode_envelopes(base.select("tie", broken.alias("value"))).select(
        "tie", "event_id", "event_type", "occurred_at", "order_id", "reject_reason"
    )


@query(
    "log_import",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, order_id, count(*) AS copies
       FROM dlv WHERE (event_id * 2 + copy) % 40 <> 7 GROUP BY ALL""",
)
def log_import(spark, sf_dir):
    """Lines in all three shapes, some broken, read back to good events."""
    frame = envelopes(spark, sf_dir)
    tie = F.col("tie")
    line = (
        F.when(tie % 40 == 7, F.lit('{"topic": "order-events", "payload": "bm90IGpzb24="}'))
        .when(tie % 3 == 0, F.col("wire"))
        .when(tie % 3 == 1, F.to_json(F.struct(F.col("topic"), F.col("wire").alias("value"))))
        .otherwise(_export(frame))
    )
    decoded = log.decode_envelopes(log.unwrap_export(frame.select(line.alias("value"))))
    return (
        decoded.filter(F.col("reject_reason").isNull())
        .groupBy("event_id", "event_type", "order_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


@query(
    "log_import_array",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, order_id, count(*) AS copies FROM dlv GROUP BY ALL",
)
def log_import_array(spark, sf_dir):
    """Exported as files of one JSON array each, envelopes and wrapped ones mixed,
    and read back by ranges of bytes."""
    frame = envelopes(spark, sf_dir)
    line = F.when(F.col("tie") % 2 == 0, F.col("wire")).otherwise(_export(frame))
    path = fresh_path(spark, "array-export")
    json_array.write_array_files(
        frame.select("tie", line.alias("line")), "line", "tie", path, files=16
    )
    return (
        log.read_export(spark, path, "array")
        .filter(F.col("reject_reason").isNull())
        .groupBy("event_id", "event_type", "order_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


@query(
    "events_by_type",
    "SELECT event_type, count(*) AS handled FROM dlv WHERE event_type <> 'order.approved' GROUP BY ALL",
)
def events_by_type(spark, sf_dir):
    tally = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("handled"))
    branches = log.events_by_type(
        adapter.deliveries(spark, sf_dir), {"order.accepted": tally, "order.scored": tally}
    )
    return branches["order.accepted"].unionByName(branches["order.scored"])


@query(
    "upsert_insert_missing",
    """SELECT s_suppkey AS warehouse_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 'new ' || s_name END AS name
       FROM supplier""",
)
def upsert_insert_missing(spark, sf_dir):
    suppliers = adapter.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").alias("warehouse_id")
    existing = suppliers.filter(F.col("s_suppkey") % 4 != 0).select(key, F.col("s_name").alias("name"))
    incoming = suppliers.select(key, F.concat(F.lit("new "), F.col("s_name")).alias("name"))
    return tables.insert_missing(existing, incoming, ["warehouse_id"])


@query(
    "upsert_stock_reset",
    """SELECT warehouse_id, sku, CASE WHEN i >= 1 THEN 500 ELSE on_hand END AS on_hand,
         CASE WHEN i >= 1 THEN 0 ELSE reserved END AS reserved,
         CASE WHEN i >= 1 THEN 500 ELSE available END AS available,
         CASE WHEN i = 1 THEN version + 1 WHEN i = 2 THEN 0 ELSE version END AS version
       FROM pst""",
)
def upsert_stock_reset(spark, sf_dir):
    cells = adapter.part_stock(spark, sf_dir)
    incoming = cells.filter(F.col("version") >= 1).withColumn("on_hand", F.lit(500).cast("bigint"))
    return tables.reset_stock(cells.filter(F.col("version") < 2), incoming)


@query(
    "ledger_snapshot",
    "SELECT warehouse_id, sku, on_hand, reserved, available, version FROM pst",
)
def ledger_snapshot(spark, sf_dir):
    return tables.stock_snapshot(adapter.part_stock(spark, sf_dir))


@query(
    "order_validate",
    """SELECT c.order_id, concat_ws(',',
         CASE WHEN coalesce(n, 0) NOT BETWEEN 1 AND 200 THEN 'items' END,
         CASE WHEN length(card_bin) <> 6 THEN 'bin' END,
         CASE WHEN c.seq % 29 = 0 THEN 'last4' END,
         CASE WHEN ip_country = '' THEN 'ip_country' END) AS failed
       FROM ctx c LEFT JOIN (SELECT seq, count(*) AS n FROM rl GROUP BY seq) USING (seq)""",
)
def order_validate(spark, sf_dir):
    orders = adapter.order_contexts(spark, sf_dir).withColumn(
        "last4",
        F.when(F.col("seq") % 29 == 0, "12").otherwise(
            F.lpad((F.col("seq") % 10000).cast("string"), 4, "0")
        ),
    )
    checked = validation.validate_orders(orders, adapter.raw_lines(spark, sf_dir))
    return checked.select("order_id", F.array_join("failed_rules", ",").alias("failed"))


@query(
    "scoring_request_validate",
    """WITH l AS (SELECT order_id, line_number, sku, CASE WHEN seq % 43 = 0 THEN 0 ELSE quantity END AS q FROM rl),
       b AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_number, sku) AS r FROM l WHERE q < 1)
       SELECT a.order_id, CASE WHEN seq % 31 = 0 THEN 'customer_id is required'
         WHEN seq % 37 = 0 THEN 'total_cents must not be negative (got ' || -total_cents || ')'
         WHEN a.order_id NOT IN (SELECT order_id FROM l) THEN 'at least one line item is required'
         WHEN b.sku IS NOT NULL THEN 'item ''' || b.sku || ''' has quantity 0, must be >= 1' ELSE '' END AS error
       FROM arr a LEFT JOIN b ON b.order_id = a.order_id AND b.r = 1""",
)
def scoring_request_validate(spark, sf_dir):
    seq = F.col("seq")
    orders = adapter.order_arrivals(spark, sf_dir).withColumns(
        {
            "customer_id": F.when(seq % 31 == 0, "").otherwise(
                F.col("customer_id").cast("string")
            ),
            "total_cents": F.when(seq % 37 == 0, -F.col("total_cents")).otherwise(
                F.col("total_cents")
            ),
        }
    )
    lines = adapter.raw_lines(spark, sf_dir).withColumn(
        "quantity", F.when(seq % 43 == 0, 0).otherwise(F.col("quantity"))
    )
    return validation.scoring_request_error(orders, lines).select("order_id", "error")


_CONFLICT = "SELECT order_id, sku FROM rl GROUP BY order_id, sku HAVING min(unit_price_cents) <> max(unit_price_cents)"


@query(
    "order_lines_merge",
    f"""SELECT order_id, sku, CAST(sum(quantity) AS BIGINT) AS quantity, min(unit_price_cents) AS unit_price_cents
        FROM rl WHERE order_id NOT IN (SELECT order_id FROM ({_CONFLICT})) GROUP BY order_id, sku""",
)
def order_lines_merge(spark, sf_dir):
    return validation.merge_lines(adapter.raw_lines(spark, sf_dir))


@query(
    "order_price_conflicts",
    f"""SELECT order_id, sku, min(unit_price_cents) AS lowest, max(unit_price_cents) AS highest
        FROM rl WHERE (order_id, sku) IN ({_CONFLICT}) GROUP BY order_id, sku""",
)
def order_price_conflicts(spark, sf_dir):
    return validation.price_conflicts(adapter.raw_lines(spark, sf_dir)).select(
        "order_id",
        "sku",
        F.col("unit_price_cents").alias("lowest"),
        F.col("highest_price_cents").alias("highest"),
    )


@query(
    "order_totals",
    """SELECT a.order_id, CASE WHEN seq % 4 <> 0 THEN total_cents ELSE coalesce(s, 0) END AS total_cents
       FROM arr a LEFT JOIN (SELECT seq, CAST(sum(unit_price_cents * quantity) AS BIGINT) AS s
                             FROM rl GROUP BY seq) USING (seq)""",
)
def order_totals(spark, sf_dir):
    orders = adapter.order_arrivals(spark, sf_dir).select(
        "order_id", F.when(F.col("seq") % 4 != 0, F.col("total_cents")).alias("total_cents")
    )
    return validation.order_totals(orders, adapter.raw_lines(spark, sf_dir))


_STATUS_SQL = """CASE seq % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'scored' WHEN 2 THEN 'reserved'
  WHEN 3 THEN 'approved' WHEN 4 THEN 'rejected' ELSE 'cancelled' END"""


def order_status():
    names = ("accepted", "scored", "reserved", "approved", "rejected", "cancelled")
    return F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % 6 + 1).cast("int"))


@query(
    "order_public_view",
    f"""SELECT order_id, status, CASE WHEN seq % 5 <> 0 AND status IN ('accepted', 'scored', 'reserved')
          THEN 'order held for review' END AS hold_reason
        FROM (SELECT *, {_STATUS_SQL} AS status FROM arr)""",
)
def order_public_view(spark, sf_dir):
    held = F.when(F.col("seq") % 5 != 0, "scored 0.72, at or above 0.65")
    return (
        adapter.order_arrivals(spark, sf_dir)
        .withColumn("status", order_status())
        .select(
            "order_id",
            "status",
            validation.public_hold_reason(F.col("status"), held).alias("hold_reason"),
        )
    )


@query("orders_visible_to", "SELECT order_id, total_cents FROM arr WHERE customer_id = 7")
def orders_visible_to(spark, sf_dir):
    return validation.visible_to(adapter.order_arrivals(spark, sf_dir), 7).select(
        "order_id", "total_cents"
    )


@query(
    "events_first_delivery",
    """SELECT event_id, partition, min("offset") AS "offset" FROM olog
       WHERE event_id NOT IN (SELECT event_id FROM lg WHERE effect = 'scored') GROUP BY event_id, partition""",
)
def events_first_delivery(spark, sf_dir):
    done = adapter.ledger(spark, sf_dir).filter(F.col("effect") == "scored")
    return delivery.first_deliveries(offset_log(spark, sf_dir), done).select(
        "event_id", "partition", "offset"
    )


@query(
    "claim_classify",
    """SELECT d.event_id, copy, CASE WHEN copy > 0 OR effect = 'scored' THEN 'duplicate'
         WHEN effect IS NOT NULL THEN 'resume' ELSE 'new' END AS claim
       FROM dlv d LEFT JOIN lg USING (event_id)""",
)
def claim_classify(spark, sf_dir):
    return delivery.classify_claims(
        adapter.deliveries(spark, sf_dir), adapter.ledger(spark, sf_dir), position="tie"
    ).select("event_id", "copy", "claim")


@query(
    "claim_complete",
    """SELECT event_id, CASE WHEN event_id % 37 = 0 AND event_id % 2 = 0 THEN 'scored' ELSE effect END AS effect,
         event_id % 37 = 0 AND event_id % 2 = 0 AS changed FROM lg""",
)
def claim_complete(spark, sf_dir):
    book = adapter.ledger(spark, sf_dir)
    outcomes = book.filter(F.col("event_id") % 2 == 0).select(
        "event_id", F.lit("scored").alias("effect")
    )
    return delivery.complete_claims(book, outcomes).select("event_id", "effect", "changed")


@query(
    "events_applied",
    "SELECT event_id, copy FROM dlv WHERE event_id IN (SELECT event_id FROM lg)",
)
def events_applied(spark, sf_dir):
    return delivery.applied_events(
        adapter.deliveries(spark, sf_dir), adapter.ledger(spark, sf_dir)
    ).select("event_id", "copy")


def effects(spark, sf_dir):
    """Ledger rows grouped so that orders have several effects each."""
    return adapter.ledger(spark, sf_dir).withColumn(
        "order_id", F.concat(F.lit("O-"), F.floor(F.col("event_id") / 4).cast("string"))
    )


@query(
    "effects_by_order",
    """SELECT event_id, order_id, effect, row_number() OVER (PARTITION BY order_id ORDER BY applied_t, event_id) AS step
       FROM (SELECT event_id, 'O-' || CAST(floor(event_id / 4) AS BIGINT) AS order_id, effect, applied_t FROM lg)""",
)
def effects_by_order(spark, sf_dir):
    return delivery.effects_in_order(effects(spark, sf_dir), "applied_t").select(
        "event_id", "order_id", "effect", "step"
    )


@query(
    "order_idempotent_replays",
    """SELECT order_id, idempotency_key, first_value(order_id) OVER w AS answered_with,
         row_number() OVER w > 1 AS is_replay FROM arr
       WINDOW w AS (PARTITION BY idempotency_key ORDER BY t, seq)""",
)
def order_idempotent_replays(spark, sf_dir):
    return delivery.replayed_orders(adapter.order_arrivals(spark, sf_dir)).select(
        "order_id", "idempotency_key", "answered_with", "is_replay"
    )


_DEAD = """SELECT task_id, queue, partition, "offset", max(attempt) AS attempts FROM att
  GROUP BY ALL HAVING max(attempt) >= 3 AND NOT bool_or(ok)"""


@query("task_dead_letters", _DEAD)
def task_dead_letters(spark, sf_dir):
    return delivery.dead_letters(adapter.attempts(spark, sf_dir))


@query(
    "log_blocked_offset",
    f'SELECT partition, min("offset") AS blocked_offset FROM ({_DEAD}) GROUP BY partition',
)
def log_blocked_offset(spark, sf_dir):
    return delivery.blocked_offsets(adapter.attempts(spark, sf_dir))


@query(
    "queue_depth",
    """SELECT event_type AS queue, count(*) FILTER (event_id % 5 = 0) AS ready,
         count(*) FILTER (event_id % 5 = 1) AS unacked, count(*) FILTER (event_id % 5 = 2) AS dead_letter
       FROM events GROUP BY 1""",
)
def queue_depth(spark, sf_dir):
    kind = F.col("event_id") % 5
    messages = adapter.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("queue"),
        F.when(kind == 0, "ready").when(kind == 1, "unacked").when(kind == 2, "dead_letter").alias(
            "state"
        ),
    )
    return delivery.queue_depth(messages)


@query(
    "rate_limit_decisions",
    """SELECT seq, key, c AS count, c <= 3 AS allowed, greatest(0, 3 - c) AS remaining
       FROM (SELECT *, row_number() OVER (PARTITION BY key, CAST(ts AS DATE) ORDER BY ts, seq) AS c FROM req)""",
)
def rate_limit_decisions(spark, sf_dir):
    return delivery.rate_limit_decisions(
        adapter.requests(spark, sf_dir), limit=3, window_seconds=86400
    ).select("seq", "key", "count", "allowed", "remaining")


@query(
    "rate_limit_windows",
    """SELECT key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS window_id, count(*) AS requests,
         least(count(*), 3) AS allowed, count(*) - least(count(*), 3) AS denied
       FROM req GROUP BY 1, 2""",
)
def rate_limit_windows(spark, sf_dir):
    return delivery.rate_limit_windows(
        adapter.requests(spark, sf_dir), limit=3, window_seconds=86400
    )
