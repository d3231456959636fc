"""Queries over customer history, features, scores and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog.registry import query
from orderlens.functions.clock import from_epoch_seconds
from orderlens.operators import history, scoring
from orderlens.operators.history import FEATURE_NAMES
from orderlens.operators.scoring import FALLBACK, MODEL

_N = ", ".join(f"round({n}, 6) AS {n}" for n in FEATURE_NAMES)


def with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_history(
        adapter.scoring_orders(spark, sf_dir),
        adapter.chargebacks(spark, sf_dir),
        volume_from=adapter.order_arrivals(spark, sf_dir),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_features(with_history(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_score(features(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_route(scored(spark, sf_dir))


def rounded(name: str):
    return F.round(name, 6).alias(name)


@query(
    "customer_history",
    """SELECT order_id, prior_orders, prior_cents, prior_bin_orders,
         round(CASE WHEN prior_orders = 0 THEN 0 ELSE mean END, 6) AS mean_cents,
         round(CASE WHEN prior_orders < 2 THEN 0 ELSE sd END, 3) AS stddev_cents FROM feat""",
)
def customer_history(spark, sf_dir):
    n = F.greatest(F.col("prior_orders"), F.lit(1)).cast("double")
    mean = F.col("prior_cents") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("prior_cents_sq") / n - mean * mean))
    return with_history(spark, sf_dir).select(
        "order_id",
        "prior_orders",
        "prior_cents",
        "prior_bin_orders",
        F.round(mean, 6).alias("mean_cents"),
        F.round(F.when(F.col("prior_orders") < 2, 0.0).otherwise(spread), 3).alias("stddev_cents"),
    )


@query("feat_amount_zscore", "SELECT order_id, round(amount_zscore, 6) AS amount_zscore FROM feat")
def feat_amount_zscore(spark, sf_dir):
    return features(spark, sf_dir).select("order_id", rounded("amount_zscore"))


@query("feat_velocity", "SELECT order_id, velocity_count, round(velocity, 6) AS velocity FROM feat")
def feat_velocity(spark, sf_dir):
    return features(spark, sf_dir).select("order_id", "velocity_count", rounded("velocity"))


@query(
    "feat_basket",
    """SELECT 'O-' || seq AS order_id, round(least(1.0::DOUBLE, distinct_skus / 8.0::DOUBLE) * 0.5
         + least(1.0::DOUBLE, total_quantity / 16.0::DOUBLE) * 0.5, 6) AS basket_size FROM bk""",
)
def feat_basket(spark, sf_dir):
    size = history.basket_feature(F.col("distinct_skus"), F.col("total_quantity"))
    return adapter.baskets(spark, sf_dir).select(
        F.concat(F.lit("O-"), F.col("seq").cast("string")).alias("order_id"),
        F.round(size, 6).alias("basket_size"),
    )


@query(
    "feat_country_mismatch",
    "SELECT order_id, country_mismatch, card_country_mismatch, ip_country_mismatch FROM feat",
)
def feat_country_mismatch(spark, sf_dir):
    orders = adapter.order_contexts(spark, sf_dir).join(
        adapter.baskets(spark, sf_dir).select("seq"), "seq", "left_semi"
    )
    shipping = F.col("shipping_country")
    return orders.select(
        "order_id",
        *[
            history.country_mismatch(F.col(left), shipping).alias(name)
            for left, name in (
                ("billing_country", "country_mismatch"),
                ("card_country", "card_country_mismatch"),
                ("ip_country", "ip_country_mismatch"),
            )
        ],
    )


@query(
    "feat_flags",
    "SELECT order_id, first_order, night_hour, coupon_first_order, gift_card FROM feat",
)
def feat_flags(spark, sf_dir):
    return features(spark, sf_dir).select(
        "order_id", "first_order", "night_hour", "coupon_first_order", "gift_card"
    )


@query(
    "feat_chargebacks",
    """SELECT order_id, prior_chargeback_count, round(prior_chargebacks, 6) AS prior_chargebacks
       FROM feat""",
)
def feat_chargebacks(spark, sf_dir):
    return features(spark, sf_dir).select(
        "order_id", "prior_chargeback_count", rounded("prior_chargebacks")
    )


@query("feat_bin_change", "SELECT order_id, bin_change FROM feat")
def feat_bin_change(spark, sf_dir):
    return features(spark, sf_dir).select("order_id", "bin_change")


@query("order_features", f"SELECT order_id, customer_id, {_N} FROM feat")
def order_features(spark, sf_dir):
    return features(spark, sf_dir).select(
        "order_id", "customer_id", *[rounded(n) for n in FEATURE_NAMES]
    )


@query(
    "feature_map",
    "SELECT order_id, "
    + " || ',' || ".join(f"printf('%.6f', {n})" for n in FEATURE_NAMES)
    + " AS vector FROM feat",
)
def feature_map(spark, sf_dir):
    held = F.col("features")
    return (
        features(spark, sf_dir)
        .select("order_id", history.feature_map().alias("features"))
        .select(
            "order_id",
            F.concat_ws(
                ",",
                *[
                    F.format_string("%.6f", F.coalesce(F.element_at(held, n), F.lit(0.0)))
                    for n in FEATURE_NAMES
                ],
            ).alias("vector"),
        )
    )


@query(
    "order_scores",
    f"""SELECT order_id, customer_id, round(score, 6) AS score, band, action,
        '{MODEL.version}' AS model_version FROM rt""",
)
def order_scores(spark, sf_dir):
    """Flagship: history, features, score, band and route for every order."""
    return routed(spark, sf_dir).select(
        "order_id", "customer_id", rounded("score"), "band", "action", "model_version"
    )


@query(
    "score_contributions",
    """SELECT order_id, rank, feature, label, round(value, 6) AS value, weight,
         round(contribution, 6) AS contribution FROM con""",
)
def score_contributions(spark, sf_dir):
    return scoring.contributions(scored(spark, sf_dir)).withColumns(
        {
            "rank": F.col("rank").cast("bigint"),
            "value": F.round("value", 6),
            "contribution": F.round("contribution", 6),
        }
    )


@query(
    "score_reasons",
    """SELECT s.order_id, coalesce(string_agg(feature, ',' ORDER BY rank)
           FILTER (contribution >= 0.18 AND value > 0 AND rank <= 5), '') AS reasons
       FROM scr s JOIN con USING (order_id) GROUP BY s.order_id""",
)
def score_reasons(spark, sf_dir):
    return scoring.with_contributions(scored(spark, sf_dir)).select(
        "order_id", F.array_join(scoring.reasons(), ",").alias("reasons")
    )


@query(
    "top_features",
    """SELECT order_id, coalesce(string_agg(feature || '=' || printf('%.6f', value), ',' ORDER BY r)
           FILTER (r <= 5 AND value > 0), '') AS top_features
       FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY value DESC, place) AS r FROM con)
       GROUP BY order_id""",
)
def top_features(spark, sf_dir):
    text = F.transform(
        scoring.top_features(5),
        lambda e: F.concat(e["feature"], F.lit("="), F.format_string("%.6f", e["value"])),
    )
    return features(spark, sf_dir).select(
        "order_id", F.array_join(text, ",").alias("top_features")
    )


@query(
    "score_bands",
    """SELECT band, count(*) AS orders, round(min(score), 6) AS lowest, round(max(score), 6) AS highest
       FROM scr GROUP BY band""",
)
def score_bands(spark, sf_dir):
    return (
        scored(spark, sf_dir)
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(F.min("score"), 6).alias("lowest"),
            F.round(F.max("score"), 6).alias("highest"),
        )
    )


@query(
    "order_routes",
    """SELECT order_id, band, action, route_reason, band IN ('ambiguous', 'high') AS reviewable,
         band = 'low' AS auto_approvable, band = 'ambiguous' AS requires_rationale FROM rt""",
)
def order_routes(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "order_id",
        "band",
        "action",
        "route_reason",
        "reviewable",
        "auto_approvable",
        "requires_rationale",
    )


@query(
    "order_scores_fallback",
    f"""SELECT order_id, round(score, 6) AS score, band, 'review' AS action, true AS degraded,
         '{FALLBACK.version}' AS model_version FROM scf""",
)
def order_scores_fallback(spark, sf_dir):
    out = scoring.with_route(scoring.with_score(features(spark, sf_dir), FALLBACK))
    return out.select("order_id", rounded("score"), "band", "action", "degraded", "model_version")


@query(
    "score_rationale",
    """WITH d AS (SELECT order_id, string_agg(label || ' (' || printf('%.2f', value) || ')', ', ' ORDER BY r)
             FILTER (r <= 2) AS two, string_agg(label || ' (' || printf('%.2f', value) || ')', ', ' ORDER BY r)
             FILTER (r <= 4) AS four
           FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY rank) AS r FROM con WHERE value > 0)
           GROUP BY order_id)
       SELECT s.order_id,
         'Scored ' || printf('%.2f', score) || ' (' || band ||
           CASE WHEN two IS NULL THEN ') with no feature above its reporting floor.'
             ELSE '); driven by ' || two || '.' END AS short_text,
         CASE WHEN four IS NULL THEN 'No risk signal fired: score ' || printf('%.2f', score) ||
             ', no feature above its floor. No behavioural or geographic anomaly detected on this order.'
           ELSE 'Scored ' || printf('%.2f', score) || ' (' || band || '). Driven by ' || four ||
             '. Combined model contribution ' || printf('%+.2f', pushed) ||
             ' logits against a base rate of ' ||
             CASE WHEN first_order > 0 THEN 'new customer' ELSE 'known customer' END || '.' END AS long_text
       FROM scr s LEFT JOIN d USING (order_id)
         JOIN (SELECT order_id, list_sum(list(contribution ORDER BY rank)) AS pushed FROM con
               GROUP BY order_id) USING (order_id)""",
)
def score_rationale(spark, sf_dir):
    return scoring.with_rationales(scored(spark, sf_dir)).select(
        "order_id", "short_text", "long_text"
    )


@query(
    "rationale_dedup",
    "SELECT substr(sha256(band || '|' || "
    + " || '|' || ".join(f"printf('%.9f', {n})" for n in FEATURE_NAMES)
    + """), 1, 32) AS rationale_key, count(*) AS orders, min(band) AS band,
         min(round(score, 6)) AS score FROM scr GROUP BY 1""",
)
def rationale_dedup(spark, sf_dir):
    return scoring.distinct_rationales(scored(spark, sf_dir))


@query(
    "orders_unscored_holds",
    """SELECT order_id, 'scored' AS status,
         'fraud scoring unavailable; held for manual review' AS hold_reason,
         'held_on_error' AS effect FROM arr WHERE order_id NOT IN (SELECT order_id FROM scr)""",
)
def orders_unscored_holds(spark, sf_dir):
    return scoring.unscored_holds(
        adapter.order_arrivals(spark, sf_dir), adapter.scoring_orders(spark, sf_dir)
    )


def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores: each scored order once, every fifth again a minute later
    by the fallback."""
    base = features(spark, sf_dir)
    trained = scoring.with_score(base).withColumn("attempt", F.lit(0))
    again = scoring.with_score(base.filter(F.col("seq") % 5 == 0), FALLBACK).withColumn(
        "attempt", F.lit(1)
    )
    both = trained.unionByName(again)
    return both.select(
        "order_id",
        (F.col("seq") * 2 + F.col("attempt")).alias("id"),
        from_epoch_seconds(F.lit(adapter.START) + F.col("t") + 60 * F.col("attempt")).alias(
            "decided_at"
        ),
        "score",
        "band",
        "model_version",
    )


@query(
    "latest_score",
    f"""SELECT order_id, seq * 2 + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS id,
         round(CASE WHEN seq % 5 = 0 THEN f.score ELSE s.score END, 6) AS score,
         CASE WHEN seq % 5 = 0 THEN f.band ELSE s.band END AS band,
         CASE WHEN seq % 5 = 0 THEN '{FALLBACK.version}' ELSE '{MODEL.version}' END AS model_version
       FROM (SELECT order_id, seq, score, band FROM scr) s
       JOIN (SELECT order_id, score, band FROM scf) f USING (order_id)""",
)
def latest_score(spark, sf_dir):
    return scoring.latest_scores(score_records(spark, sf_dir)).select(
        "order_id", "id", rounded("score"), "band", "model_version"
    )


@query(
    "fraud_rate",
    """SELECT count(*) AS total, count(*) FILTER (band = 'low') AS low,
         count(*) FILTER (band = 'ambiguous') AS ambiguous, count(*) FILTER (band = 'high') AS high,
         round(avg(score), 6) AS mean_score,
         round(count(*) FILTER (band = 'high') / count(*)::DOUBLE, 6) AS fraud_rate FROM scr""",
)
def fraud_rate(spark, sf_dir):
    return scoring.fraud_rate(scored(spark, sf_dir)).withColumns(
        {"mean_score": F.round("mean_score", 6), "fraud_rate": F.round("fraud_rate", 6)}
    )


@query(
    "scorer_health",
    f"""SELECT '{MODEL.version}' AS model_version, false AS degraded, count(*) AS orders_scored,
         count(DISTINCT customer_id) AS tracked_customers FROM scr""",
)
def scorer_health(spark, sf_dir):
    return scoring.scorer_health(scored(spark, sf_dir))


@query(
    "velocity_as_of",
    """SELECT customer_id, count(*) AS orders_so_far, count(*) FILTER (t >= 36000 - 900) AS velocity_count,
         least(1.0::DOUBLE, count(*) FILTER (t >= 36000 - 900) / 5.0::DOUBLE) AS velocity
       FROM arr WHERE t <= 36000 GROUP BY customer_id""",
)
def velocity_as_of(spark, sf_dir):
    return history.velocity_as_of(adapter.order_arrivals(spark, sf_dir), "2024-01-01 10:00:00")
