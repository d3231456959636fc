"""Queries over stock, allocation, reservations, orders and the whole flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog import risk
from orderlens.catalog.intake import order_status
from orderlens.catalog.prelude import LEDGER, TURNS
from orderlens.catalog.registry import query
from orderlens.functions.clock import ntz
from orderlens.operators import allocation, flow, inventory, ledger, orders, scoring, turns
from orderlens.plans.storage import pinned, stored
from orderlens.sources import log

NOW = "2024-01-01 06:30:00"


def cell_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged lines as requests to one warehouse each."""
    return adapter.timed_lines(spark, sf_dir).withColumn(
        "warehouse_id", adapter.warehouse_name(1 + F.col("seq") % 12)
    )


@query(
    "pick_warehouse",
    "SELECT DISTINCT order_id, b.warehouse_id FROM ln LEFT JOIN bests b USING (order_id)",
)
def pick_warehouse(spark, sf_dir):
    return inventory.pick_warehouse(adapter.lines(spark, sf_dir), adapter.stock(spark))


@query(
    "reserve_orders_snapshot",
    "SELECT order_id, warehouse_id, reason IS NULL AS reserved, reason FROM alloc",
)
def reserve_orders_snapshot(spark, sf_dir):
    return inventory.reserve_from_snapshot(
        adapter.lines(spark, sf_dir), adapter.stock(spark)
    ).select("order_id", "warehouse_id", "reserved", "reason")


@query(
    "order_shortfalls",
    """SELECT a.order_id, a.warehouse_id, l.sku, l.quantity, a.reason
       FROM alloc a JOIN ln l USING (order_id)
       LEFT JOIN stk s ON s.warehouse_id = a.warehouse_id AND s.sku = l.sku
       WHERE a.reason IS NOT NULL AND coalesce(s.available, -1) < l.quantity""",
)
def order_shortfalls(spark, sf_dir):
    """The lines of refused orders that fell short, as their events list them."""
    lines = adapter.lines(spark, sf_dir)
    outcomes = inventory.reserve_from_snapshot(lines, adapter.stock(spark))
    none = adapter.reservations(spark, sf_dir).select(
        "reservation_id", "order_id", "warehouse_id", F.lit("held").alias("state"), "expires_at"
    ).limit(0)
    made = inventory.inventory_events(none, outcomes, lines)
    told = log.decode_payload(made, "inventory.shortfall").select(
        "body.order_id", "body.warehouse_id", "body.reason", F.inline("body.requested")
    )
    return told.select(
        "order_id", F.nullif("warehouse_id", F.lit("none")).alias("warehouse_id"), "sku", "quantity", "reason"
    )


@query(
    "reserve_fold",
    """WITH RECURSIVE r AS (
         SELECT 'WH-' || lpad(CAST(1 + l.seq % 12 AS VARCHAR), 2, '0') AS warehouse_id, l.sku, l.seq, l.t, l.quantity
         FROM ln l),
       q AS MATERIALIZED (SELECT r.*, coalesce(s.available, 0) AS available,
             row_number() OVER (PARTITION BY r.warehouse_id, r.sku ORDER BY r.t, r.seq) AS i
           FROM r LEFT JOIN stk s USING (warehouse_id, sku)),
       f AS (SELECT warehouse_id, sku, seq, quantity, i, available >= quantity AS admitted,
               available - CASE WHEN available >= quantity THEN quantity ELSE 0 END AS remaining FROM q WHERE i = 1
         UNION ALL
         SELECT q.warehouse_id, q.sku, q.seq, q.quantity, q.i, f.remaining >= q.quantity,
               f.remaining - CASE WHEN f.remaining >= q.quantity THEN q.quantity ELSE 0 END
         FROM f JOIN q ON q.warehouse_id = f.warehouse_id AND q.sku = f.sku AND q.i = f.i + 1)
       SELECT warehouse_id, sku, seq, quantity, admitted FROM f""",
)
def reserve_fold(spark, sf_dir):
    return inventory.reserve_in_order(cell_requests(spark, sf_dir), adapter.stock(spark))


@query(
    "reserve_unit_admission",
    """SELECT q.warehouse_id, q.sku, q.seq, q.turn, q.turn <= coalesce(s.available, 0) AS admitted
       FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_id, sku ORDER BY t, seq) AS turn
             FROM (SELECT *, 'WH-' || lpad(CAST(1 + seq % 12 AS VARCHAR), 2, '0') AS warehouse_id FROM ln)) q
       LEFT JOIN stk s USING (warehouse_id, sku)""",
)
def reserve_unit_admission(spark, sf_dir):
    return inventory.admit_units(cell_requests(spark, sf_dir), adapter.stock(spark)).select(
        "warehouse_id", "sku", "seq", "turn", "admitted"
    )


@query("reserve_orders_fold")
def reserve_orders_fold(spark, sf_dir):
    """Exact allocation in arrival order; brute force checks it in the tests."""
    return allocation.allocate(adapter.timed_lines(spark, sf_dir), adapter.stock(spark))


@query(
    "reserve_orders_live",
    f"""WITH RECURSIVE asking AS (SELECT DISTINCT order_id FROM ln), {TURNS}
        SELECT order_id, warehouse_id, reserved, reason FROM won""",
)
def reserve_orders_live(spark, sf_dir):
    """Exact allocation in arrival order with picks at each order's turn."""
    return turns.allocate_in_turn(adapter.timed_lines(spark, sf_dir), adapter.stock(spark))


@query(
    "refusal_attribution",
    """WITH firsts AS (SELECT order_id, min(sku) AS sku FROM ln GROUP BY order_id)
       SELECT a.order_id, coalesce(a.warehouse_id, s.warehouse_id, 'none') AS warehouse_id
       FROM alloc a LEFT JOIN firsts f ON f.order_id = a.order_id AND a.warehouse_id IS NULL
       LEFT JOIN stk s ON s.sku = f.sku WHERE a.reason IS NOT NULL""",
)
def refusal_attribution(spark, sf_dir):
    lines, cells = adapter.lines(spark, sf_dir), adapter.stock(spark)
    return inventory.refusal_attribution(
        lines, inventory.reserve_from_snapshot(lines, cells), cells
    )


@query(
    "shortfall_rate",
    """SELECT coalesce(warehouse_id, 'none') AS warehouse_id, count(*) AS attempts,
         count(reason) AS refused, round(count(reason) / count(*)::DOUBLE, 6) AS refusal_ratio
       FROM alloc GROUP BY 1""",
)
def shortfall_rate(spark, sf_dir):
    outcomes = inventory.reserve_from_snapshot(adapter.lines(spark, sf_dir), adapter.stock(spark))
    return inventory.shortfall_rate(outcomes).withColumn(
        "refusal_ratio", F.round("refusal_ratio", 6)
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock movements from the lines: reserve, then commit, release or neither.

    Every 61st order releases twice, which the guard must notice.
    """
    seq, copy = F.col("seq"), F.col("copy")
    later = F.when(seq % 2 == 0, "commit").when(seq % 3 == 0, "release")
    kinds = F.array(
        F.lit("reserve"), later, F.when(seq % 61 == 0, "release")
    )
    return (
        cell_requests(spark, sf_dir)
        .select("*", F.posexplode(kinds).alias("copy", "kind"))
        .filter(F.col("kind").isNotNull())
        .select(
            "warehouse_id",
            "sku",
            "kind",
            "quantity",
            (F.col("t") + copy * 300).alias("t"),
            (seq * 3 + copy).alias("seq"),
        )
    )


_MOVES = """m AS (SELECT 'WH-' || lpad(CAST(1 + seq % 12 AS VARCHAR), 2, '0') AS warehouse_id, sku, kind,
             quantity AS q, t + 300 * c AS t, seq * 3 + c AS seq
           FROM ln, range(0, 3) r(c), LATERAL (SELECT CASE c WHEN 0 THEN 'reserve'
             WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN 'commit' WHEN seq % 3 = 0 THEN 'release' END
             ELSE CASE WHEN seq % 61 = 0 THEN 'release' END END AS kind) k WHERE kind IS NOT NULL)"""


def opening_stock(spark: SparkSession) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return adapter.stock(spark).withColumns(
        {"on_hand": F.col("available"), "reserved": zero, "version": zero}
    )


@query(
    "ledger_replay",
    f"""WITH RECURSIVE {_MOVES}, {LEDGER},
       g AS (SELECT warehouse_id, sku, arg_max(h, n) AS h, arg_max(r, n) AS r, arg_max(a, n) AS a,
               max(v) AS v, max(x) AS x FROM led GROUP BY warehouse_id, sku)
       SELECT warehouse_id, sku, CAST(coalesce(h, available) AS BIGINT) AS on_hand,
         coalesce(r, 0) AS reserved, CAST(coalesce(a, available) AS BIGINT) AS available,
         coalesce(v, 0) AS version, coalesce(x, 0) AS refused
       FROM stk LEFT JOIN g USING (warehouse_id, sku)""",
)
def ledger_replay(spark, sf_dir):
    """Stock cells after the movements that their guards let through."""
    return ledger.replay_ledger(opening_stock(spark), movements(spark, sf_dir))


@query(
    "ledger_refusals",
    f"""WITH RECURSIVE {_MOVES}, {LEDGER}
       SELECT mo.warehouse_id, mo.sku, mo.kind, mo.q AS quantity, mo.t, mo.seq
       FROM mo JOIN led ON mo.warehouse_id = led.warehouse_id AND mo.sku = led.sku AND mo.n = led.n
       WHERE NOT led.ok""",
)
def ledger_refusals(spark, sf_dir):
    """Movements that changed nothing: not covered, or of a cell without stock."""
    return ledger.refused_movements(opening_stock(spark), movements(spark, sf_dir)).select(
        "warehouse_id", "sku", "kind", "quantity", "t", "seq"
    )


def holds_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hold; the even ones carry a snapshot of their lines."""
    snapshot = (
        adapter.lines(spark, sf_dir)
        .filter(F.col("seq") % 2 == 0)
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(F.struct("sku", "quantity"))).alias("lines"))
    )
    return adapter.reservations(spark, sf_dir).join(snapshot, "order_id", "left")


@query(
    "reservations_create",
    """SELECT 'R-' || a.order_id AS reservation_id, a.order_id, 'WH-' || lpad(CAST(1 + a.seq % 12 AS VARCHAR), 2, '0') AS warehouse_id,
         'held' AS state, received_at + INTERVAL 900 SECOND AS expires_at,
         coalesce(string_agg(sku || 'x' || quantity, ',' ORDER BY sku), '') AS lines
       FROM arr a LEFT JOIN ln USING (seq) WHERE a.seq % 3 = 0 GROUP BY ALL""",
)
def reservations_create(spark, sf_dir):
    granted = adapter.reservations(spark, sf_dir).select("order_id", "warehouse_id", "created_at")
    made = inventory.create_reservations(granted, adapter.lines(spark, sf_dir))
    text = F.transform("lines", lambda e: F.concat(e["sku"], F.lit("x"), e["quantity"].cast("string")))
    return made.select(
        "reservation_id",
        "order_id",
        "warehouse_id",
        "state",
        "expires_at",
        F.coalesce(F.array_join(text, ","), F.lit("")).alias("lines"),
    )


@query(
    "reservation_lines",
    "SELECT reservation_id, sku, quantity FROM rsv JOIN ln USING (order_id)",
)
def reservation_lines(spark, sf_dir):
    return inventory.reservation_lines(
        holds_with_lines(spark, sf_dir), adapter.lines(spark, sf_dir)
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.settle_reservations(
        adapter.reservations(spark, sf_dir), adapter.transitions(spark, sf_dir)
    )


@query(
    "reservation_state",
    """SELECT reservation_id, order_id, warehouse_id, CASE arg_min(transition, t) WHEN 'commit' THEN 'committed'
         WHEN 'release' THEN 'released' ELSE 'held' END AS state, min(t) AS settled_t,
         greatest(count(t) - 1, 0) AS noops
       FROM rsv LEFT JOIN trn USING (reservation_id) GROUP BY ALL""",
)
def reservation_state(spark, sf_dir):
    return settled(spark, sf_dir)


@query(
    "reservations_expired",
    f"""SELECT reservation_id, expires_at FROM rsv WHERE state = 'held' AND expires_at < TIMESTAMP '{NOW}'""",
)
def reservations_expired(spark, sf_dir):
    return inventory.expired(adapter.reservations(spark, sf_dir), ntz(NOW)).select(
        "reservation_id", "expires_at"
    )


@query(
    "sweep_effects",
    f"""SELECT warehouse_id, sku, CAST(sum(quantity) AS BIGINT) AS released_units, count(*) AS released_lines
        FROM rsv JOIN ln USING (order_id) WHERE state = 'held' AND expires_at < TIMESTAMP '{NOW}'
        GROUP BY warehouse_id, sku""",
)
def sweep_effects(spark, sf_dir):
    return inventory.sweep_effects(
        holds_with_lines(spark, sf_dir), adapter.lines(spark, sf_dir), ntz(NOW)
    )


@query("reservations_active", "SELECT count(*) AS active FROM rsv WHERE state = 'held'")
def reservations_active(spark, sf_dir):
    return inventory.active_count(adapter.reservations(spark, sf_dir))


@query(
    "stock_by_sku",
    "SELECT sku, CAST(sum(available) AS BIGINT) AS total_available, count(*) AS warehouses FROM pst GROUP BY sku",
)
def stock_by_sku(spark, sf_dir):
    return inventory.stock_by_sku(adapter.part_stock(spark, sf_dir))


@query(
    "inventory_events",
    """WITH st AS (SELECT order_id, warehouse_id, reservation_id, strftime(expires_at, '%Y-%m-%dT%H:%M:%S.000Z') AS e,
             CASE arg_min(transition, t) WHEN 'commit' THEN 'committed' WHEN 'release' THEN 'released' END AS state
           FROM rsv LEFT JOIN trn USING (reservation_id) GROUP BY ALL)
       SELECT event_type, count(*) AS events, count(DISTINCT order_id) AS orders FROM (
         SELECT 'inventory.reserved' AS event_type, order_id FROM st
         UNION ALL SELECT 'inventory.' || state, order_id FROM st WHERE state IS NOT NULL
         UNION ALL SELECT 'inventory.shortfall', order_id FROM alloc WHERE reason IS NOT NULL)
       GROUP BY event_type""",
)
def inventory_events(spark, sf_dir):
    """Built, encoded and decoded again with the payload schema of each type."""
    lines = adapter.lines(spark, sf_dir)
    due = adapter.reservations(spark, sf_dir).select(
        "reservation_id", F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expires_at")
    )
    made = inventory.inventory_events(
        settled(spark, sf_dir).join(due, "reservation_id"),
        inventory.reserve_from_snapshot(lines, adapter.stock(spark)),
        lines,
    )
    kinds = ("reserved", "released", "committed", "shortfall")
    decoded = None
    for kind in kinds:
        part = log.decode_payload(made, f"inventory.{kind}").select(
            "event_type", F.col("body.order_id").alias("order_id")
        )
        decoded = part if decoded is None else decoded.unionByName(part)
    per_order = decoded.groupBy("event_type", "order_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_order.groupBy("event_type").agg(
        F.sum("_n").alias("events"), F.count("order_id").alias("orders")
    )


@query(
    "reservations_missing",
    """SELECT order_id, warehouse_id, 'held' AS state, expires_at FROM rsv WHERE seq % 5 = 0""",
)
def reservations_missing(spark, sf_dir):
    rows = adapter.reservations(spark, sf_dir)
    events = rows.select(
        "order_id",
        "warehouse_id",
        F.col("created_at").alias("occurred_at"),
        F.array().cast("array<struct<sku:string,quantity:int>>").alias("lines"),
    )
    kept = rows.filter(F.col("seq") % 5 != 0).select("order_id", "warehouse_id")
    return inventory.missing_reservations(events.unionByName(events), kept).select(
        "order_id", "warehouse_id", "state", "expires_at"
    )


@query(
    "inventory_outcomes",
    """SELECT count(*) FILTER (state = 'released') AS released, count(*) FILTER (state = 'committed') AS committed,
         CAST(sum(noops) AS BIGINT) AS noops,
         (SELECT count(*) FROM alloc WHERE reason IS NULL) AS reserved,
         (SELECT count(*) FROM alloc WHERE reason IS NOT NULL) AS shortfalls,
         (SELECT count(*) - count(DISTINCT event_id) FROM dlv) AS duplicates
       FROM (SELECT CASE arg_min(transition, t) WHEN 'commit' THEN 'committed' WHEN 'release' THEN 'released' END AS state,
               greatest(count(t) - 1, 0) AS noops FROM rsv LEFT JOIN trn USING (reservation_id) GROUP BY reservation_id)""",
)
def inventory_outcomes(spark, sf_dir):
    return inventory.outcome_tallies(
        settled(spark, sf_dir),
        inventory.reserve_from_snapshot(adapter.lines(spark, sf_dir), adapter.stock(spark)),
        adapter.deliveries(spark, sf_dir),
    )


@query(
    "order_fanout",
    """SELECT 'order' AS kind, order_id, 0 AS line_id, 'accepted' AS what FROM arr JOIN bk USING (seq)
       UNION ALL SELECT 'audit', order_id, 0, 'accepted' FROM arr JOIN bk USING (seq)
       UNION ALL SELECT 'line', order_id, row_number() OVER (PARTITION BY order_id ORDER BY sku) - 1,
         sku || 'x' || quantity FROM ln""",
)
def order_fanout(spark, sf_dir):
    items = (
        adapter.lines(spark, sf_dir)
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(F.struct("sku", "quantity"))).alias("items"))
    )
    head, lines, audit = orders.fan_out(
        adapter.order_arrivals(spark, sf_dir).join(items, "order_id")
    )
    zero = F.lit(0).cast("bigint").alias("line_id")
    return (
        head.select(F.lit("order").alias("kind"), "order_id", zero, F.col("status").alias("what"))
        .unionByName(
            audit.select(
                F.lit("audit").alias("kind"),
                F.col("entity_id").alias("order_id"),
                zero,
                F.col("action").alias("what"),
            )
        )
        .unionByName(
            lines.select(
                F.lit("line").alias("kind"),
                "order_id",
                F.col("line_id").cast("bigint").alias("line_id"),
                F.concat("sku", F.lit("x"), F.col("quantity").cast("string")).alias("what"),
            )
        )
    )


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to five status updates per order."""
    seq = F.col("seq")

    def step(number: int, status, reason=None, score=None):
        return F.struct(
            F.lit(number).alias("step"),
            (status if not isinstance(status, str) else F.lit(status)).alias("status"),
            (F.lit(None).cast("string") if reason is None else reason).alias("hold_reason"),
            (F.lit(None).cast("double") if score is None else score).alias("score"),
        )

    reviewed = F.when(seq % 3 == 0, "approved").when(seq % 3 == 1, "rejected")
    steps = F.array(
        step(0, "accepted"),
        step(
            1, "scored", F.when(seq % 5 == 0, "held for review"), (seq % 100).cast("double") / 100.0
        ),
        step(2, reviewed),
        step(3, F.when(seq % 17 == 0, "cancelled")),
        step(
            4,
            F.when(seq % 34 == 0, "scored"),
            F.lit("stock unavailable: insufficient stock"),
            F.lit(0.5),
        ),
    )
    score = F.col("score")
    return (
        adapter.order_arrivals(spark, sf_dir)
        .select("order_id", "t", F.inline(steps))
        .filter(F.col("status").isNotNull())
        .withColumn("band", scoring.band(score))
    )


@query(
    "order_current_state",
    """SELECT order_id,
         CASE WHEN seq % 34 = 0 THEN 'scored' WHEN seq % 17 = 0 THEN 'cancelled' WHEN seq % 3 = 0 THEN 'approved'
           WHEN seq % 3 = 1 THEN 'rejected' ELSE 'scored' END AS status,
         CASE WHEN seq % 34 = 0 THEN 'stock unavailable: insufficient stock' WHEN seq % 17 = 0 OR seq % 3 = 1 THEN NULL
           WHEN seq % 5 = 0 THEN 'held for review' END AS hold_reason,
         CASE WHEN seq % 34 = 0 THEN 0.5 ELSE (seq % 100)::DOUBLE / 100.0::DOUBLE END::DOUBLE AS score,
         CASE WHEN seq % 34 = 0 THEN 'ambiguous' WHEN seq % 100 < 35 THEN 'low' WHEN seq % 100 < 65 THEN 'ambiguous' ELSE 'high' END AS band
       FROM arr""",
)
def order_current_state(spark, sf_dir):
    return orders.current_state(status_updates(spark, sf_dir), ["t", "step"])


@query(
    "orders_by_status",
    """SELECT CASE seq % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'scored' WHEN 2 THEN 'reserved'
         WHEN 3 THEN 'approved' WHEN 4 THEN 'rejected' ELSE 'cancelled' END AS status, count(*) AS orders
       FROM arr GROUP BY 1""",
)
def orders_by_status(spark, sf_dir):
    return orders.count_by_status(
        adapter.order_arrivals(spark, sf_dir).withColumn("status", order_status())
    )


@query(
    "orders_needing_stock",
    """SELECT order_id FROM arr WHERE seq % 5 = 1
       AND order_id NOT IN (SELECT order_id FROM rsv WHERE state = 'held')""",
)
def orders_needing_stock(spark, sf_dir):
    status = F.when(F.col("seq") % 5 == 1, "scored").otherwise("approved")
    book = adapter.order_arrivals(spark, sf_dir).withColumn("status", status)
    return orders.needing_stock(book, adapter.reservations(spark, sf_dir)).select("order_id")


@query(
    "order_detail",
    """WITH s AS (SELECT order_id, round(CASE WHEN seq % 5 = 0 THEN f ELSE score END, 6) AS score FROM
             (SELECT order_id, seq, score FROM scr) JOIN (SELECT order_id, score AS f FROM scf) USING (order_id)),
       l AS (SELECT order_id, string_agg(sku || 'x' || quantity, ',' ORDER BY sku) AS lines FROM ln GROUP BY order_id)
       SELECT order_id, total_cents, coalesce(lines, '') AS lines, score
       FROM arr LEFT JOIN l USING (order_id) LEFT JOIN s USING (order_id)""",
)
def order_detail(spark, sf_dir):
    newest = scoring.latest_scores(risk.score_records(spark, sf_dir)).select("order_id", "score")
    text = F.transform("lines", lambda e: F.concat(e["sku"], F.lit("x"), e["quantity"].cast("string")))
    return orders.detail(
        adapter.order_arrivals(spark, sf_dir), adapter.lines(spark, sf_dir), newest
    ).select(
        "order_id",
        "total_cents",
        F.array_join(text, ",").alias("lines"),
        F.round("score", 6).alias("score"),
    )


_OUTCOME = """
  SELECT a.order_id, a.seq, rt.score, rt.band, rt.action,
    CASE WHEN rt.action = 'approve' AND al.reason IS NULL THEN 'reserved' ELSE 'scored' END AS status,
    CASE WHEN rt.order_id IS NULL THEN 'fraud scoring unavailable; held for manual review'
      WHEN rt.action = 'review' THEN route_reason
      WHEN al.reason IS NOT NULL THEN 'stock unavailable: ' || al.reason END AS hold_reason,
    CASE WHEN rt.action = 'approve' AND al.reason IS NULL THEN al.warehouse_id END AS warehouse_id
  FROM arr a LEFT JOIN rt USING (order_id) LEFT JOIN alloc al ON al.order_id = a.order_id"""


@query(
    "approve_or_hold",
    f"SELECT order_id, band, status, hold_reason FROM ({_OUTCOME}) WHERE score IS NOT NULL",
)
def approve_or_hold(spark, sf_dir):
    return flow.outcome(
        risk.routed(spark, sf_dir), adapter.lines(spark, sf_dir), adapter.stock(spark)
    ).select("order_id", "band", "status", "hold_reason")


APPROVED_IN_TURN = f"""WITH RECURSIVE asking AS (SELECT order_id FROM rt WHERE action = 'approve'), {TURNS}
  SELECT rt.order_id, band, CASE WHEN won.reserved THEN 'reserved' ELSE 'scored' END AS status,
    CASE WHEN action = 'review' THEN route_reason WHEN NOT won.reserved THEN 'stock unavailable: ' || won.reason END AS hold_reason,
    CASE WHEN action = 'approve' THEN warehouse_id END AS warehouse_id
  FROM rt LEFT JOIN won USING (order_id)"""


@query("approve_in_turn", APPROVED_IN_TURN)
def approve_in_turn(spark, sf_dir):
    """Approved orders compete for the stock in arrival order; nothing is oversold."""
    routed = risk.routed(spark, sf_dir).select("order_id", "score", "band", "action", "route_reason")
    return flow.outcome_in_turn(
        stored(routed, "turns-routed"), adapter.timed_lines(spark, sf_dir), adapter.stock(spark)
    ).select("order_id", "band", "status", "hold_reason", "warehouse_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.decide(
        adapter.deliveries(spark, sf_dir),
        adapter.ledger(spark, sf_dir),
        risk.routed(spark, sf_dir).drop("seq", "t"),
        adapter.lines(spark, sf_dir),
        adapter.stock(spark),
    )


_WORK = f"""
  SELECT o.*, w.event_id, w.claim FROM ({_OUTCOME}) o JOIN (
    SELECT d.event_id, d.order_id, CASE WHEN effect IS NULL THEN 'new' ELSE 'resume' END AS claim
    FROM dlv d LEFT JOIN lg USING (event_id) WHERE copy = 0 AND coalesce(effect, 'accepted') = 'accepted') w
  USING (order_id)"""


@query(
    "order_batch_decisions",
    f"""SELECT event_id, order_id, claim, round(score, 6) AS score, band, status, hold_reason, warehouse_id
        FROM ({_WORK})""",
)
def order_batch_decisions(spark, sf_dir):
    won = F.when(F.col("status") == "reserved", F.col("warehouse_id"))
    return decisions(spark, sf_dir).select(
        "event_id",
        "order_id",
        "claim",
        F.round("score", 6).alias("score"),
        "band",
        "status",
        "hold_reason",
        won.alias("warehouse_id"),
    )


@query(
    "order_batch_outputs",
    f"""WITH w AS ({_WORK})
        SELECT 'fraud_scores' AS output, count(*) AS n FROM w WHERE score IS NOT NULL
        UNION ALL SELECT 'order_status', count(*) FROM w UNION ALL SELECT 'audit_log', count(*) FROM w
        UNION ALL SELECT 'events', count(*) FROM w WHERE score IS NOT NULL
        UNION ALL SELECT 'review_items', count(*) FROM w WHERE status <> 'reserved'
        UNION ALL SELECT 'reservations', count(*) FROM w WHERE status = 'reserved'""",
)
def order_batch_outputs(spark, sf_dir):
    parts = flow.outputs(pinned(decisions(spark, sf_dir)))
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "processor_outcomes",
    f"""WITH w AS ({_WORK}) SELECT (SELECT count(*) FROM dlv) AS handled,
          (SELECT count(*) FROM dlv) - count(*) AS duplicates, count(*) FILTER (action = 'approve') AS approved,
          count(*) FILTER (action = 'review') AS held, count(*) FILTER (score IS NULL) AS held_on_error FROM w""",
)
def processor_outcomes(spark, sf_dir):
    return flow.tallies(
        adapter.deliveries(spark, sf_dir),
        adapter.ledger(spark, sf_dir),
        decisions(spark, sf_dir),
    )


