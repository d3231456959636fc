import json
import zlib

import pytest
from pyspark.sql import functions as F

from orderlens.functions import clock
from orderlens.operators import delivery, validation
from orderlens.sources import log

ENVELOPE = {
    "event_id": "e1",
    "event_type": "order.accepted",
    "occurred_at": "2024-01-01T00:00:05Z",
    "correlation_id": "c",
    "order_id": None,
    "offset": 4,
    "partition": 1,
    "schema_version": 1,
    "payload": {"order_id": "O-1", "customer_id": "C", "total_cents": 4800,
                "items": [{"sku": "A", "quantity": 2, "unit_price_cents": 2400}]},
}


def decoded(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return log.decode_envelopes(log.unwrap_export(df)).collect()


def test_three_export_shapes_read_alike(spark, tmp_path):
    import base64

    plain = json.dumps(ENVELOPE)
    wrapped = json.dumps({"topic": "t", "payload": base64.b64encode(plain.encode()).decode()})
    as_text = json.dumps({"topic": "t", "value": plain})
    rows = decoded(spark, [plain, wrapped, as_text])
    assert all(r.reject_reason is None and r.event_id == "e1" and r.order_id == "O-1" for r in rows)
    (tmp_path / "a.json").write_text(json.dumps([ENVELOPE, ENVELOPE]))
    assert log.read_export(spark, str(tmp_path / "a.json"), "array").filter(
        "reject_reason is null and order_id = 'O-1'"
    ).count() == 2
    (tmp_path / "b.json").write_text(plain + "\n\n" + wrapped + "\n")
    assert log.read_export(spark, str(tmp_path / "b.json")).count() == 2


def test_bad_records_are_kept_apart(spark):
    bad = [
        "{",
        "[1]",
        json.dumps(ENVELOPE | {"event_type": "order.lost"}),
        json.dumps(ENVELOPE | {"event_id": ""}),
        json.dumps(ENVELOPE | {"occurred_at": "soon"}),
        json.dumps({"payload": "bm90IGpzb24="}),
    ]
    got = [r.reject_reason for r in decoded(spark, [*bad, json.dumps(ENVELOPE)])]
    assert got[-1] is None and all(got[:-1])


def test_payload_is_typed(spark):
    df = spark.createDataFrame([(json.dumps(ENVELOPE),)], "value string")
    row = log.decode_payload(log.decode_envelopes(df), "order.accepted").first()
    assert row.body.total_cents == 4800 and row.body["items"][0].quantity == 2


def test_partition_is_crc32(spark):
    keys = ["O-1", "", "Ü", "x" * 100]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r.p for r in df.select(log.partition_for(F.col("k")).alias("p")).collect()]
    assert got == [zlib.crc32(k.encode()) % 6 for k in keys]


def test_offsets_count_per_partition_under_skew(spark):
    df = spark.range(400).select(
        F.lit("t").alias("topic"),
        (F.col("id") % 10 == 0).cast("int").alias("partition"),
        "id",
    )
    out = log.assign_offsets(df, "id", "id", hot_rows=30)
    assert log.end_offsets(out).orderBy("partition").collect()[0].end_offset == 360
    assert out.select("partition", "offset").distinct().count() == 400


def test_lag_without_a_commit_is_everything(spark):
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 5)], "topic string, partition int, end_offset long")
    commits = spark.createDataFrame(
        [("g", "t", 0, 12)], "consumer_group string, topic string, partition int, committed long"
    )
    assert log.group_lag(ends, commits).first().lag == 5


def test_claims(spark):
    records = spark.createDataFrame(
        [("a", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 5)], "event_id string, offset long"
    ).withColumn("partition", F.lit(0))
    ledger = spark.createDataFrame(
        [("b", "accepted"), ("c", "scored"), ("d", "accepted")], "event_id string, effect string"
    )
    scores = spark.createDataFrame([("d",)], "event_id string")
    got = {r.offset: r.claim for r in delivery.classify_claims(records, ledger, scores).collect()}
    assert got == {0: "new", 1: "duplicate", 2: "resume", 3: "duplicate", 4: "duplicate", 5: "duplicate"}
    got = {r.offset: r.claim for r in delivery.classify_claims(records, ledger).collect()}
    assert (got[4], got[5]) == ("resume", "duplicate")
    twins = spark.createDataFrame(
        [("a", 1, 5), ("a", 0, 5)], "event_id string, partition long, offset long"
    )
    got = {r.partition: r.claim for r in delivery.classify_claims(twins, ledger).collect()}
    assert got == {0: "new", 1: "duplicate"}
    outcomes = spark.createDataFrame([("b", "scored")] * 2, "event_id string, effect string")
    done = delivery.complete_claims(ledger, outcomes).collect()
    assert len(done) == 3 and {r.event_id for r in done if r.changed} == {"b"}


def test_first_delivery_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("event_id"), F.lit(0).alias("partition"), F.col("id").alias("offset")
    )
    out = delivery.first_deliveries(df)
    assert sorted(r.offset for r in out.collect()) == [0, 1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_three_failures_block_a_partition(spark):
    rows = [(1, "q", 0, 10, a, False) for a in (1, 2, 3)] + [(2, "q", 0, 8, a, a == 3) for a in (1, 2, 3)]
    rows += [(3, "q", 1, 4, 1, False)]
    df = spark.createDataFrame(rows, "task_id int, queue string, partition int, offset long, attempt int, ok boolean")
    assert [tuple(r) for r in delivery.blocked_offsets(df).collect()] == [(0, 10)]
    assert delivery.dead_letters(df, 1).count() == 2


@pytest.mark.parametrize("hot_rows", [4, 10_000])
def test_rate_limit_in_fixed_windows(spark, hot_rows):
    df = spark.range(30).select(
        F.lit("k").alias("key"), "id", clock.from_epoch_seconds(F.col("id") * 4).alias("ts"),
        F.col("id").alias("seq"),
    )
    out = delivery.rate_limit_decisions(df, limit=5, hot_rows=hot_rows).orderBy("seq").collect()
    assert [r.allowed for r in out] == [i % 15 < 5 for i in range(30)]
    assert [r.remaining for r in out] == [max(0, 4 - i % 15) for i in range(30)]


def test_order_rules(spark):
    orders = spark.createDataFrame(
        [("O-1", "C", 10, "411111", "1234", "US", "US", "US", None, None),
         ("O-2", "", -1, "4111", "123", "USA", "US", "US", "", "x" * 65)],
        "order_id string, customer_id string, total_cents long, card_bin string, last4 string, card_country string,"
        " billing_country string, shipping_country string, ip_country string, coupon_code string",
    )
    lines = spark.createDataFrame([("O-1", "A", 1, 5), ("O-2", "", 10000, -1)], "order_id string, sku string, quantity int, unit_price_cents long")
    got = {r.order_id: r.failed_rules for r in validation.validate_orders(orders, lines).collect()}
    assert got["O-1"] == []
    assert got["O-2"] == ["customer_id", "sku", "quantity", "unit_price_cents", "bin", "last4",
                          "card_country", "ip_country", "coupon_code", "total_cents"]


def test_price_conflict_rejects_the_whole_order(spark):
    lines = spark.createDataFrame(
        [("O-1", "A", 1, 5), ("O-1", "A", 2, 5), ("O-2", "A", 1, 5), ("O-2", "A", 1, 6), ("O-2", "B", 1, 1)],
        "order_id string, sku string, quantity int, unit_price_cents long",
    )
    assert [tuple(r) for r in validation.merge_lines(lines).collect()] == [("O-1", "A", 3, 5)]
    assert validation.price_conflicts(lines).first().sku == "A"


def test_times(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2023-12-31T19:00:00-0500", "x", None, "2024-13-01T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(clock.epoch_micros(clock.parse_iso_utc(F.col("t"))).alias("x")).collect()]
    assert got == [1704067200000000] * 4 + [None] * 3


def test_text_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        seconds = F.lit(1710037800)  # 02:30 on a day that skips 02:00 to 03:00
        at = clock.add_seconds(clock.from_epoch_seconds(seconds), 1)
        row = spark.range(1).select(
            clock.iso_utc(at).alias("iso"),
            clock.epoch_micros(at).alias("us"),
            F.unix_micros(clock.as_instant(at)).alias("instant"),
            clock.epoch_micros(clock.parse_iso_utc(clock.iso_utc(at))).alias("back"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.iso == "2024-03-10T02:30:01.000000Z"
    assert row.us == row.instant == row.back == 1710037801000000
