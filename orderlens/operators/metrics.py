"""Counters, histograms, percentiles, rates and alerts over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.clock import MICROS, epoch_micros, epoch_seconds
from orderlens.plans.storage import pinned

SCORE_BUCKETS = tuple(round(0.05 * i, 2) for i in range(1, 21))
GUARD = 0.001
#: Stretches that a level of ``nearest_rank`` cuts the values into, and how many
#: values it looks up at the end.
CUTS = 64
KEPT_SAMPLES = 100_000


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(
    events: DataFrame, value: Column, bounds: tuple[float, ...], labels: list[str] | None = None
) -> DataFrame:
    """Cumulative counts at every bound and at infinity.

    Each row is counted once into its own bucket; the running sum is over the
    bounds only. ``le`` is null for infinity.
    """
    labels = labels or []
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(value <= bounds[i], i).otherwise(slot)
    filled = events.groupBy(*labels, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    per_slot = [
        F.sum(F.when(F.col("_slot") <= i, F.col("_n")).otherwise(0)) for i in range(len(bounds))
    ]
    edges = [F.lit(float(b)) for b in bounds] + [F.lit(None).cast("double")]
    wide = filled.groupBy(*labels).agg(
        F.array(*per_slot, F.sum("_n")).alias("_cumulative")
    )
    zipped = F.arrays_zip(F.array(*edges).alias("le"), F.col("_cumulative").alias("cumulative"))
    return wide.select(*labels, F.posexplode(zipped).alias("_i", "_b")).select(
        *labels, F.col("_b.le").alias("le"), F.col("_b.cumulative").alias("cumulative")
    )


def bucket_percentiles(
    buckets: DataFrame, fractions: dict[str, float], labels: list[str] | None = None
) -> DataFrame:
    """The smallest bound that covers each fraction of the observations.

    Observations above the last finite bound are not counted into n, so a
    percentile is always a bound.
    """
    labels = labels or []
    finite = buckets.filter(F.col("le").isNotNull())
    sized = finite.groupBy(*labels).agg(
        F.max("cumulative").alias("observations"),
        F.array_sort(F.collect_list(F.struct("le", "cumulative"))).alias("_b"),
    )

    def at(fraction: float) -> Column:
        covered = F.filter(
            "_b", lambda e: e["cumulative"] >= F.lit(fraction) * F.col("observations")
        )
        return F.when(F.col("observations") <= 0, 0.0).otherwise(F.get(covered, F.lit(0))["le"])

    return sized.select(
        *labels, "observations", *[at(f).alias(name) for name, f in fractions.items()]
    )


def interpolated_quantiles(
    buckets: DataFrame, fractions: dict[str, float], labels: list[str] | None = None
) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank.

    A rank in the infinite bucket gives the last finite bound.
    """
    labels = labels or []
    cells = buckets.groupBy(*labels).agg(
        F.max("cumulative").alias("_n"),
        F.max("le").alias("_last"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("le").isNotNull(), F.struct("le", "cumulative"))
            )
        ).alias("_b"),
    )

    def quantile(fraction: float) -> Column:
        rank = F.lit(fraction) * F.col("_n")
        index = F.size(F.filter("_b", lambda e: e["cumulative"] < rank))
        upper = F.get("_b", index)
        lower = F.when(index > 0, F.get("_b", index - 1))
        low_edge = F.coalesce(lower["le"], F.lit(0.0))
        low_count = F.coalesce(lower["cumulative"], F.lit(0))
        share = F.try_divide(rank - low_count, upper["cumulative"] - low_count)
        return F.when(upper.isNull(), F.col("_last")).otherwise(
            low_edge + (upper["le"] - low_edge) * share
        )

    return cells.select(*labels, *[quantile(f).alias(name) for name, f in fractions.items()])


def nearest_rank(
    samples: DataFrame,
    value: str,
    fractions: dict[str, float],
    labels: list[str],
    kept: int = KEPT_SAMPLES,
) -> DataFrame:
    """Exact percentiles by rank, half to even, per label; null values are no samples.

    Nothing is sorted. Each level cuts the values that may still hold a rank at
    quantiles of a sketch, counts the stretches between cuts and goes on inside
    the one that holds the rank; cuts count apart, so a value of any number of
    copies ends the search. What is left of ``kept`` values or fewer is looked up.
    A level is two partial aggregations, whatever share of the samples a label has.

    Returns the labels, a column per fraction, ``count, max, mean``.
    """
    rows = samples.select(*labels, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    sizes = pinned(
        rows.groupBy(*labels).agg(
            F.count(F.lit(1)).alias("count"),
            F.max("_v").alias("max"),
            F.avg("_v").alias("mean"),
            F.min("_v").alias("_min"),
        )
    )
    rank = F.bround(F.col("_f") * F.col("count"), 0)
    names = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(f)).alias("_f")) for n, f in fractions.items()])
    # a row per label and fraction: the rank within the values from _low to _high
    search = sizes.select("*", F.inline(names)).select(
        *labels,
        "_name",
        F.greatest(F.lit(1), F.least(F.col("count"), rank)).cast("bigint").alias("_rank"),
        F.col("_min").alias("_low"),
        F.col("max").alias("_high"),
        F.col("count").alias("_inside"),
    )
    whose = [*labels, "_name"]
    found = []

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names], F.lit(True))

    def within(search: DataFrame) -> DataFrame:
        joined = rows.alias("r").join(search.alias("s"), same(rows, search, labels))
        return joined.filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).select(
            "s.*", "_v"
        )

    while True:
        equal, few = F.col("_low") == F.col("_high"), F.col("_inside") <= kept
        found.append(search.filter(equal).select(*whose, F.col("_low").alias("_value")))
        found.append(
            within(search.filter(~equal & few))
            .groupBy(*whose, "_rank")
            .agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # ``kept`` values at most
            .select(*whose, F.get("_all", (F.col("_rank") - 1).cast("int")).alias("_value"))
        )
        search = search.filter(~equal & ~few)
        if search.isEmpty():
            break
        shares = [i / CUTS for i in range(CUTS + 1)]
        cuts = within(search).groupBy(*search.columns).agg(
            F.array_sort(F.array_distinct(F.percentile_approx("_v", shares, 100 * CUTS))).alias("_cuts")
        )
        # the stretches between cuts are even, the cuts themselves odd
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        place = 2 * below + F.array_contains("_cuts", F.col("_v")).cast("int")
        counted = (
            within(pinned(cuts))
            .withColumn("_place", place)
            .groupBy(*whose, "_rank", "_place")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        )
        upto = F.sum("_n").over(Window.partitionBy(*whose).orderBy("_place"))  # 2 * CUTS rows
        search = pinned(
            counted.withColumn("_upto", upto)
            .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
            .select(
                *whose,
                (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"),
                "_low",
                "_high",
                F.col("_n").alias("_inside"),
            )
        )
    every = reduce(DataFrame.unionByName, found)
    wide = every.groupBy(*labels).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in fractions]
    )
    return wide.join(sizes.drop("_min"), same(wide, sizes, labels)).select(
        *[wide[c] for c in labels], *fractions, "count", "max", "mean"
    )


def rates(events: DataFrame, labels: list[str], window_seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows, per label set."""
    start = F.floor(epoch_seconds(F.col("ts")) / window_seconds) * window_seconds
    return (
        events.groupBy(*labels, start.cast("bigint").alias("window_start"))
        .agg(F.count(F.lit(1)).alias("increase"))
        .withColumn("per_second", F.col("increase") / F.lit(float(window_seconds)))
    )


def guarded_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole.cast("double"), F.lit(GUARD))


def ratio_by_window(events: DataFrame, condition: Column, window_seconds: int) -> DataFrame:
    start = F.floor(epoch_seconds(F.col("ts")) / window_seconds) * window_seconds
    return (
        events.groupBy(start.cast("bigint").alias("window_start"))
        .agg(
            F.count(F.when(condition, 1)).alias("matching"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("ratio", guarded_ratio(F.col("matching"), F.col("total")))
    )


def sustained_alerts(
    series: DataFrame,
    firing: Column,
    labels: list[str],
    window_seconds: int,
    for_seconds: int,
) -> DataFrame:
    """Spells in which a condition held in every window for long enough.

    ``series`` is one row per label set and window, so a label's rows are as
    many as there are windows. A window without a row ends a spell.
    """
    order = Window.partitionBy(*labels).orderBy("window_start")
    lit = series.filter(firing)
    island = F.col("window_start") - F.row_number().over(order) * window_seconds
    spells = (
        lit.withColumn("_island", island)
        .groupBy(*labels, "_island")
        .agg(
            F.min("window_start").alias("started"),
            (F.max("window_start") + window_seconds).alias("ended"),
        )
        .drop("_island")
    )
    return spells.withColumn("held_seconds", F.col("ended") - F.col("started")).filter(
        F.col("held_seconds") >= for_seconds
    )


def heartbeat_gaps(
    beats: DataFrame, labels: list[str], max_gap_seconds: int = 300
) -> DataFrame:
    """Silences longer than a limit between consecutive beats of a label.

    A slot as long as the limit cannot contain such a silence, so only its
    first and last beat matter: beats are combined map-side and the window
    runs over slots.
    """
    limit = max_gap_seconds * MICROS
    us = epoch_micros(F.col("ts"))
    edges = beats.groupBy(*labels, F.floor(us / limit).cast("bigint").alias("_slot")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last")
    )
    across = Window.partitionBy(*labels).orderBy("_slot")
    return (
        edges.withColumn("_next", F.lead("_first").over(across))
        .filter(F.col("_next") - F.col("_last") > limit)
        .select(
            *labels,
            F.col("_last").alias("silent_from_us"),
            ((F.col("_next") - F.col("_last")) / F.lit(float(MICROS))).alias("gap_seconds"),
        )
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Producer, drain and end-to-end rates per run, in events per second.

    ``runs``: ``run, published_t, handled_t``. Generation lasts from the first
    to the last publish; the drain from there to the last handled event.
    """
    bounds = runs.groupBy("run").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("published_t").alias("_from"),
        F.max("published_t").alias("_until"),
        F.max("handled_t").alias("_done"),
    )
    drained = (
        runs.join(bounds.select("run", "_until"), "run")
        .groupBy("run")
        .agg(F.count(F.when(F.col("handled_t") > F.col("_until"), 1)).alias("drained"))
    )
    generating = (F.col("_until") - F.col("_from")).cast("double")
    draining = F.greatest(F.lit(0.0), (F.col("_done") - F.col("_until")).cast("double"))
    zero = F.lit(0.0)
    return bounds.join(drained, "run").select(
        "run",
        "events",
        "drained",
        F.coalesce(F.try_divide(F.col("events"), generating), zero).alias("producer_per_sec"),
        F.coalesce(F.try_divide(F.col("drained"), draining), zero).alias("drain_per_sec"),
        F.coalesce(F.try_divide(F.col("events"), generating + draining), zero).alias(
            "end_to_end_per_sec"
        ),
    )


def metric_totals(counted: DataFrame, name: str = "metric") -> DataFrame:
    """Sums over all label sets of each metric."""
    return counted.groupBy(name).agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("series")
    )


LATENCY_BUCKETS = schemas.LATENCY_BUCKETS_SECONDS
