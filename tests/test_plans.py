"""What the plans must look like for large tables."""

import re

import pytest
from pyspark.sql import functions as F

from orderlens import adapter
from orderlens.catalog import QUERIES
from orderlens.catalog.risk import with_history
from orderlens.plans import running

SF_DIR = "/root/testdata/sf0.001"
# they run jobs of their own while they are built
EAGER = {n for n in QUERIES if n.startswith("stream_")} | {
    "reserve_orders_fold", "order_batch_outputs", "reserve_orders_live", "approve_in_turn"
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_large_tables_meet_only_in_shuffles(spark, no_broadcast, name):
    """With tables too large to broadcast: no cross join, no forced broadcast,
    no Python outside the one bounded fold."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "NestedLoop", "BroadcastExchange", "EvalPython"):
        assert word not in plan
    if name != "reserve_fold":
        assert "InPandas" not in plan


def test_all_history_windows_share_one_shuffle(spark, no_broadcast):
    plan = plan_of(with_history(spark, SF_DIR))
    above = plan.split("Exchange hashpartitioning(customer_id")[0]
    assert above.count("Window [") == 3
    assert above.count("Exchange") == 0


def test_a_visibility_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["orders_visible_to"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,7\)", plan)


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(adapter.baskets(spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    plan = plan_of(QUERIES["rate_limit_windows"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_top_k_does_not_sort_the_table(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["reviews_pending_topk"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["order_scores", "order_features", "log_assign_offsets", "review_decisions"])
def test_hot_keys_change_no_result(spark, monkeypatch, name):
    from orderlens.operators import history, reviews
    from orderlens.plans import running
    from orderlens.sources import log

    usual = QUERIES[name](spark, SF_DIR)
    kept = usual.collect()
    tight = 1
    monkeypatch.setattr(history.with_history, "__kwdefaults__",
                        {**history.with_history.__kwdefaults__, "hot_rows": tight})
    monkeypatch.setattr(log.assign_offsets, "__defaults__", (tight,))
    monkeypatch.setattr(reviews.decide, "__defaults__", (tight,))
    assert running.HOT_ROWS > tight
    sliced = QUERIES[name](spark, SF_DIR)
    assert "_slice" in sliced._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, sliced.collect()), key=repr) == sorted(map(tuple, kept), key=repr)


def test_percentiles_sort_nothing(spark):
    plan = plan_of(QUERIES["latency_percentiles"](spark, SF_DIR))
    assert "Window" not in plan and "Sort [" not in plan.split("SortAggregate")[0]


def test_cuts_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "MOST_CUTS", 32)
    for n in (5_000, 40_000):
        df = spark.range(n).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
            (F.col("id") * 7 % 1000).alias("t"),
            "id",
        )
        slices = running.measure_slices(df, ["k"], "t", "id", 100)
        cuts = [len(r["_cuts"]) for r in slices.levels[0].collect()]
        assert sum(cuts) <= 2 * 32
        numbered = running.row_numbers(df, ["k"], "t", "id", hot_rows=100)
        hot = [r.rn for r in numbered.filter("k = 'hot'").orderBy("t", "id").collect()]
        assert hot == list(range(1, len(hot) + 1))
