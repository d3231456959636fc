"""The test tables restated in plain SQL, shared by the oracle statements.

These are common table expressions over the given views, written apart from
the Spark code: windows here, running totals and partial aggregates there.
"""

from __future__ import annotations

from orderlens.operators.history import FEATURE_NAMES
from orderlens.operators.scoring import FALLBACK, MODEL, REASON_LABELS, RiskModel


def _mismatch(left: str, right: str) -> str:
    return (
        f"CASE WHEN coalesce({left}, '') = '' OR coalesce({right}, '') = '' THEN 0.0 "
        f"WHEN lower(trim({left})) = lower(trim({right})) THEN 0.0 ELSE 1.0 END::DOUBLE"
    )


def _logit(model: RiskModel) -> str:
    terms = " + ".join(f"{model.weight(n)}::DOUBLE * {n}" for n in FEATURE_NAMES)
    return f"{model.intercept}::DOUBLE + {terms}"


def scored_sql(model: RiskModel, source: str = "feat") -> str:
    return f"""
      SELECT *, 1.0 / (1.0 + exp(-logit)) AS score,
        CASE WHEN 1.0 / (1.0 + exp(-logit)) < 0.35 THEN 'low'
             WHEN 1.0 / (1.0 + exp(-logit)) < 0.65 THEN 'ambiguous' ELSE 'high' END AS band
      FROM (SELECT *, {_logit(model)} AS logit FROM {source})"""


_UNPIVOT = " UNION ALL ".join(
    f"SELECT order_id, {i} AS place, '{n}' AS feature, '{REASON_LABELS[n].replace(chr(39), chr(39) * 2)}' AS label, "
    f"{n} AS value, {MODEL.weight(n)}::DOUBLE AS weight FROM scr"
    for i, n in enumerate(FEATURE_NAMES)
)

_MONEY = "CAST(round(o_totalprice * 100) AS BIGINT)"
_T = "(o_orderkey * 7919) % 43200"
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds({})"
_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

CTES: dict[str, str] = {
    "arr": f"""
      SELECT o_orderkey AS seq, 'O-' || o_orderkey AS order_id, o_custkey AS customer_id,
        {_MONEY} AS total_cents, {_T} AS t, {_AT.format(_T)} AS received_at,
        o_orderstatus AS source_status,
        'K-' || CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS idempotency_key,
        CAST(o_custkey * 31 + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS card_bin,
        CASE WHEN o_orderkey % 13 = 0 THEN 'SAVE10' END AS coupon_code,
        o_orderkey % 20 = 0 AS is_gift_card
      FROM orders""",
    "ctx": """
      SELECT a.*,
        coalesce(lpad(CAST(n AS VARCHAR), 2, '0'), '') AS billing_country,
        coalesce(lpad(CAST(CASE WHEN seq % 10 = 0 THEN (n + 1) % 25 ELSE n END AS VARCHAR), 2, '0'), '') AS shipping_country,
        coalesce(lpad(CAST(CASE WHEN seq % 17 = 0 THEN (n + 2) % 25 ELSE n END AS VARCHAR), 2, '0'), '') AS card_country,
        CASE WHEN seq % 41 = 0 THEN ''
          ELSE coalesce(lpad(CAST(CASE WHEN seq % 23 = 0 THEN (n + 3) % 25 ELSE n END AS VARCHAR), 2, '0'), '') END AS ip_country
      FROM arr a LEFT JOIN (SELECT c_custkey, c_nationkey AS n FROM customer) c ON c.c_custkey = a.customer_id""",
    "rl": """
      SELECT l_orderkey AS seq, 'O-' || l_orderkey AS order_id, l_linenumber AS line_number,
        'SKU-' || lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') AS sku,
        1 + CAST(l_quantity AS INTEGER) % 3 AS quantity,
        CAST(1000 + 37 * (l_partkey % 24)
          + CASE WHEN l_orderkey % 19 = 0 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unit_price_cents
      FROM lineitem""",
    "ln": """
      SELECT seq, order_id, sku, CAST(sum(quantity) AS INTEGER) AS quantity, (seq * 7919) % 43200 AS t
      FROM rl GROUP BY seq, order_id, sku""",
    "bk": """
      SELECT seq, count(DISTINCT sku) AS distinct_skus, CAST(sum(quantity) AS BIGINT) AS total_quantity
      FROM rl GROUP BY seq""",
    "so": "SELECT c.*, distinct_skus, total_quantity FROM ctx c JOIN bk USING (seq)",
    "cbk": f"""
      SELECT o_custkey AS customer_id, o_orderkey AS seq, 3600 + {_T} AS t FROM orders WHERE o_orderkey % 50 = 0""",
    "cb1": f"""
      SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER
          (PARTITION BY customer_id ORDER BY t, k, seq {_PRIOR}) AS orders_before
      FROM (SELECT customer_id, t, 0 AS k, seq FROM so UNION ALL SELECT customer_id, t, 1, seq FROM cbk)""",
    "cb2": f"""
      SELECT seq, k, CAST(coalesce(sum(CASE WHEN k = 1 AND orders_before > 0 THEN 1 ELSE 0 END) OVER
          (PARTITION BY customer_id ORDER BY t, k, seq {_PRIOR}), 0) AS BIGINT) AS prior_chargeback_count
      FROM cb1""",
    "hist": f"""
      SELECT so.*,
        count(*) OVER w AS prior_orders,
        CAST(coalesce(sum(total_cents) OVER w, 0) AS BIGINT) AS prior_cents,
        CAST(coalesce(sum(CAST(total_cents AS HUGEINT) * total_cents) OVER w, 0) AS DOUBLE) AS prior_cents_sq,
        count(nullif(card_bin, '')) OVER w AS prior_bin_orders,
        row_number() OVER (PARTITION BY customer_id, card_bin ORDER BY t, so.seq) = 1 AS bin_is_new,
        count(*) OVER (PARTITION BY customer_id ORDER BY t RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)
          - count(*) OVER (PARTITION BY customer_id, t)
          + row_number() OVER (PARTITION BY customer_id, t ORDER BY so.seq) - 1 AS velocity_count,
        prior_chargeback_count
      FROM so JOIN cb2 ON cb2.seq = so.seq AND cb2.k = 0
      WINDOW w AS (PARTITION BY customer_id ORDER BY t, so.seq {_PRIOR})""",
    "feat": f"""
      SELECT *,
        CASE WHEN prior_orders < 3 THEN 0.0
          WHEN sd <= 0 THEN CASE WHEN total_cents > mean THEN 4.0 ELSE 0.0 END
          ELSE greatest(0.0, least(4.0, (total_cents - mean) / sd)) END::DOUBLE / 4.0 AS amount_zscore,
        least(1.0::DOUBLE, velocity_count / 5.0::DOUBLE) AS velocity,
        least(1.0::DOUBLE, distinct_skus / 8.0::DOUBLE) * 0.5 + least(1.0::DOUBLE, total_quantity / 16.0::DOUBLE) * 0.5 AS basket_size,
        {_mismatch('billing_country', 'shipping_country')} AS country_mismatch,
        {_mismatch('card_country', 'shipping_country')} AS card_country_mismatch,
        {_mismatch('ip_country', 'shipping_country')} AS ip_country_mismatch,
        CASE WHEN prior_orders = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS first_order,
        CASE WHEN hour(received_at) < 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS night_hour,
        CASE WHEN prior_orders = 0 AND coalesce(coupon_code, '') <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS coupon_first_order,
        CASE WHEN is_gift_card THEN 1.0 ELSE 0.0 END::DOUBLE AS gift_card,
        CASE WHEN prior_orders = 0 THEN 0.0
          ELSE least(1.0::DOUBLE, 4.0::DOUBLE * (prior_chargeback_count / prior_orders::DOUBLE)) END::DOUBLE AS prior_chargebacks,
        CASE WHEN prior_bin_orders > 0 AND (card_bin = '' OR bin_is_new) THEN 1.0 ELSE 0.0 END::DOUBLE AS bin_change
      FROM (SELECT *, prior_cents / greatest(prior_orders, 1)::DOUBLE AS mean,
              sqrt(greatest(0.0::DOUBLE, prior_cents_sq / greatest(prior_orders, 1)
                - (prior_cents / greatest(prior_orders, 1)::DOUBLE) * (prior_cents / greatest(prior_orders, 1)::DOUBLE))) AS sd
            FROM hist)""",
    "scr": scored_sql(MODEL),
    "scf": scored_sql(FALLBACK),
    "rt": """
      SELECT *, CASE WHEN band = 'low' THEN 'approve' ELSE 'review' END AS action,
        'scored ' || printf('%.2f', score) || CASE band WHEN 'low' THEN ', below 0.35'
          WHEN 'high' THEN ', at or above 0.65' ELSE ', inside the ambiguous band' END AS route_reason
      FROM scr""",
    "con": f"""
      SELECT *, weight * value AS contribution,
        row_number() OVER (PARTITION BY order_id ORDER BY weight * value DESC, place) AS rank
      FROM ({_UNPIVOT})""",
    "stk": """
      SELECT 'WH-' || lpad(CAST(wh AS VARCHAR), 2, '0') AS warehouse_id,
        'SKU-' || lpad(CAST(sku_no AS VARCHAR), 2, '0') AS sku, 150 + (sku_no * 13 + wh * 7) % 220 AS available
      FROM range(1, 13) w(wh), range(0, 23) s(sku_no) WHERE (sku_no + wh) % 5 <> 0""",
    "pst": """
      SELECT 'WH-' || lpad(CAST(1 + (p_partkey * 5 + i * 7) % 12 AS VARCHAR), 2, '0') AS warehouse_id,
        'P-' || p_partkey AS sku, p_partkey, i,
        CAST(CASE WHEN p_partkey % 89 = 0 AND i = 0 THEN 5 ELSE 20 + p_size * 3 + i END AS BIGINT) AS on_hand,
        CAST((p_partkey + i) % 10 AS BIGINT) AS reserved,
        CAST(CASE WHEN p_partkey % 89 = 0 AND i = 0 THEN -5
          WHEN p_partkey % 97 = 0 THEN 20 + p_size * 3 + i - (p_partkey + i) % 10 - 1
          ELSE 20 + p_size * 3 + i - (p_partkey + i) % 10 END AS BIGINT) AS available,
        CAST(i AS BIGINT) AS version
      FROM part, range(0, 3) r(i)""",
    "dlv": f"""
      SELECT o_orderkey AS event_id, 'order-events' AS topic, 'O-' || o_orderkey AS order_id,
        CASE WHEN o_orderkey % 12 = 5 THEN 'order.scored' WHEN o_orderkey % 12 = 7 THEN 'order.approved'
          ELSE 'order.accepted' END AS event_type,
        CAST(o_orderkey % 6 AS INTEGER) AS partition, {_T} + 30 * copy AS t, o_orderkey * 2 + copy AS tie,
        CAST(copy AS INTEGER) AS copy, o_custkey AS customer_id
      FROM orders, range(0, 2) r(copy) WHERE copy = 0 OR o_orderkey % 7 = 0""",
    "lg": """
      SELECT event_id, 'order-events' AS topic, 'order-processor' AS consumer_group, 'O-' || event_id AS order_id,
        CASE WHEN event_id % 37 = 0 THEN 'accepted' ELSE 'scored' END AS effect,
        abs(event_id) * 7919 % 43200 + 5 AS applied_t
      FROM (SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 101 <> 0
            UNION ALL SELECT * FROM range(-2, 0))""",
    "olog": """
      SELECT *, row_number() OVER (PARTITION BY partition ORDER BY t, tie) - 1 AS "offset" FROM dlv""",
    "rsv": f"""
      SELECT o_orderkey AS seq, 'R-' || o_orderkey AS reservation_id, 'O-' || o_orderkey AS order_id,
        'WH-' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') AS warehouse_id,
        {_AT.format(_T)} AS created_at, {_AT.format('900 + ' + _T)} AS expires_at,
        CASE WHEN o_orderkey % 4 = 1 THEN 'committed' WHEN o_orderkey % 4 = 2 THEN 'released' ELSE 'held' END AS state
      FROM orders WHERE o_orderkey % 3 = 0""",
    "trn": f"""
      SELECT 'R-' || o_orderkey AS reservation_id, transition, {_T} + delay AS t
      FROM orders JOIN (VALUES (1, 'commit', 300), (1, 'release', 600), (2, 'release', 400),
        (3, 'release', 500), (3, 'commit', 200)) v(r, transition, delay) ON o_orderkey % 4 = r
      WHERE o_orderkey % 3 = 0""",
    "rev": f"""
      SELECT 'V-' || o_orderkey AS review_id, 'O-' || o_orderkey AS order_id, o_orderkey AS seq, status,
        {_AT.format(_T)} AS created_at, {_AT.format('3600 + ' + _T)} AS sla_deadline,
        CASE WHEN status <> 'pending' AND o_orderkey % 210 <> 18 THEN 'supervisor' END AS decided_by,
        CASE WHEN status <> 'pending' THEN {_AT.format('1800 + ' + _T)} END AS decided_at
      FROM (SELECT *, CASE WHEN o_orderkey % 5 <= 1 THEN 'pending' WHEN o_orderkey % 5 = 2 THEN 'approved'
              WHEN o_orderkey % 5 = 3 THEN 'rejected' ELSE 'expired' END AS status FROM orders)
      WHERE o_orderkey % 6 = 0""",
    "dec": f"""
      SELECT 'V-' || o_orderkey AS review_id, 'O-' || o_orderkey AS order_id, o_orderkey * 2 + copy AS seq,
        CASE WHEN o_orderkey % 22 = 0 THEN 'expired'
          WHEN (o_orderkey % 3 <> 0) <> (copy = 1) THEN 'approved' ELSE 'rejected' END AS decision,
        {_T} + 600 + 600 * copy AS t, CASE WHEN copy = 1 THEN 'second reader' ELSE 'supervisor' END AS decided_by
      FROM orders, range(0, 2) r(copy) WHERE o_orderkey % 2 = 0 AND (copy = 0 OR o_orderkey % 5 = 0)""",
    "req": """
      SELECT event_id AS seq, user_id AS key, ts, event_type AS outcome, value AS latency_ms, props FROM events""",
    "att": """
      SELECT event_id AS task_id, CASE WHEN event_id % 2 = 0 THEN 'reviews' ELSE 'notifications' END AS queue,
        CAST(event_id % 6 AS INTEGER) AS partition, event_id AS "offset", CAST(attempt AS INTEGER) AS attempt,
        attempt = 1 + event_id % 3 AND NOT (event_id % 3 = 2 AND event_id % 11 = 0) AS ok
      FROM events, range(1, 4) r(attempt) WHERE attempt <= 1 + event_id % 3""",
    "bests": """
      SELECT seq, order_id, warehouse_id FROM (
        SELECT l.seq, l.order_id, s.warehouse_id, row_number() OVER
          (PARTITION BY l.seq ORDER BY s.available - l.quantity DESC, s.warehouse_id) AS rn
        FROM ln l JOIN stk s USING (sku) WHERE s.available >= l.quantity) WHERE rn = 1""",
    "alloc": """
      SELECT o.seq, o.order_id, b.warehouse_id,
        CASE WHEN b.warehouse_id IS NULL THEN 'no warehouse holds these items'
          WHEN bool_and(coalesce(s.available, -1) >= l.quantity) THEN NULL ELSE 'insufficient stock' END AS reason
      FROM (SELECT DISTINCT seq, order_id FROM ln) o
      JOIN ln l ON l.seq = o.seq
      LEFT JOIN bests b ON b.seq = o.seq
      LEFT JOIN stk s ON s.warehouse_id = b.warehouse_id AND s.sku = l.sku
      GROUP BY o.seq, o.order_id, b.warehouse_id""",
}

#: The guarded ledger of movements ``m`` (``warehouse_id, sku, kind, q, t, seq``), one
#: movement of every cell a step; ``led`` has a row per movement and one before all.
LEDGER = """mo AS (SELECT m.*, s.available AS a0,
           row_number() OVER (PARTITION BY m.warehouse_id, m.sku ORDER BY t, seq, kind, q) AS n
         FROM m LEFT JOIN stk s ON s.warehouse_id = m.warehouse_id AND s.sku = m.sku),
       led AS (
         SELECT DISTINCT warehouse_id, sku, 0::BIGINT AS n, a0::BIGINT AS h, 0::BIGINT AS r, a0::BIGINT AS a,
           0::BIGINT AS v, 0::BIGINT AS x, true AS ok FROM mo
         UNION ALL
         SELECT warehouse_id, sku, n, CASE WHEN ok AND kind = 'commit' THEN h - q ELSE h END,
           CASE WHEN NOT ok THEN r WHEN kind = 'reserve' THEN r + q ELSE r - q END,
           CASE WHEN NOT ok OR kind = 'commit' THEN a WHEN kind = 'reserve' THEN a - q ELSE a + q END,
           CASE WHEN ok THEN v + 1 ELSE v END, CASE WHEN ok THEN x ELSE x + 1 END, ok
         FROM (SELECT led.warehouse_id, led.sku, mo.n, h, r, a, v, x, kind, q,
                 coalesce(CASE WHEN kind = 'reserve' THEN a >= q ELSE a0 IS NOT NULL AND r >= q END, false) AS ok
               FROM led JOIN mo ON mo.warehouse_id = led.warehouse_id AND mo.sku = led.sku AND mo.n = led.n + 1))"""

#: Orders ``asking`` (``order_id``) one after another, each picking from what the ones before
#: it left. ``a`` holds the units of all cells, 12 to a SKU, -1 where there is none.
TURNS = """ord AS MATERIALIZED (SELECT order_id, row_number() OVER (ORDER BY t, seq) AS n, l FROM (
           SELECT order_id, min(t) AS t, min(seq) AS seq,
             list({'s': CAST(right(sku, 2) AS INTEGER) * 12, 'q': quantity}) AS l
           FROM ln SEMI JOIN asking USING (order_id) GROUP BY order_id)),
       turn AS (
         SELECT 0::BIGINT AS n, (SELECT list(coalesce(available, -1) ORDER BY sku_no, wh)
             FROM range(0, 24) s(sku_no), range(1, 13) w(wh) LEFT JOIN stk
               ON right(sku, 2) = lpad(CAST(sku_no AS VARCHAR), 2, '0') AND right(warehouse_id, 2) = lpad(CAST(wh AS VARCHAR), 2, '0')) AS a,
           NULL::VARCHAR AS order_id, NULL::BIGINT AS w, false AS ok
         UNION ALL
         SELECT n, CASE WHEN ok THEN list_transform(a, lambda x, i: x - coalesce(list_sum(list_transform(
               list_filter(l, lambda e: e.s + w = i), lambda e: e.q)), 0)::BIGINT) ELSE a END, order_id, w, ok
         FROM (SELECT *, w IS NOT NULL AND len(list_filter(l, lambda e: a[e.s + w] < e.q)) = 0 AS ok
               FROM (SELECT ord.n, turn.a, ord.order_id, ord.l, list_min(list_transform(
                         list_filter(l, lambda e: list_max(a[e.s + 1:e.s + 12]) >= e.q),
                         lambda e: {'m': e.q - list_max(a[e.s + 1:e.s + 12]),
                           'w': list_position(a[e.s + 1:e.s + 12], list_max(a[e.s + 1:e.s + 12]))})).w::BIGINT AS w
                     FROM turn JOIN ord ON ord.n = turn.n + 1)))
       , won AS (SELECT order_id, 'WH-' || lpad(CAST(w AS VARCHAR), 2, '0') AS warehouse_id, ok AS reserved,
           CASE WHEN w IS NULL THEN 'no warehouse holds these items' WHEN NOT ok THEN 'insufficient stock' END AS reason
         FROM turn WHERE n > 0)"""


def oracle(statement: str) -> str:
    """A statement with the table expressions above in front of it."""
    body = statement.strip()
    head = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in CTES.items())
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
