"""Running totals per key, in order, when one key may hold most of the rows.

A window is one task per key. That is the right plan for ordinary keys and a
dead end for a hot one, so a hot key is cut into consecutive slices of its own
order: each slice is windowed on its own and starts from the total of the
slices before it. Which keys are hot is measured first, with one aggregation
over the key and position columns. Cuts are rows of the order itself, compared
in the types of its columns. Without hot keys nothing is cut and the plan is
the plain single-shuffle window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.plans.storage import pinned

HOT_ROWS = 1_000_000
SLICES_PER_QUOTA = 8
#: Sampled rows from one cut to the next, so that slices are of about one size.
SAMPLES_PER_SLICE = 64
#: Cuts of all keys together, and with them the rows of a table of cuts and of its
#: samples. Larger tables get longer slices instead of more cuts.
MOST_CUTS = 1 << 14
#: Steps of the search for a slice: more cuts of one key than any table has.
_STEPS = [1 << i for i in range(24, -1, -1)]


@dataclass(frozen=True)
class Slices:
    """Where hot keys are cut.

    ``levels`` is empty or holds one table with a row per hot key: its cuts,
    ``(position, tie)`` in order, ``SLICES_PER_QUOTA`` of them for ``HOT_ROWS``
    rows, ``MOST_CUTS`` in all. It is written once, so every branch of a plan and every retry cuts
    alike.
    """

    keys: tuple[str, ...]
    levels: tuple[DataFrame, ...] = ()

    @property
    def any(self) -> bool:
        return bool(self.levels)

    @property
    def columns(self) -> list[str]:
        return [f"_slice{i + 1}" for i in range(len(self.levels))]

    @property
    def group(self) -> list[str]:
        return [*self.keys, *self.columns]

    def apply(self, df: DataFrame, position: str, tie: str) -> DataFrame:
        """Add the slice columns; ordinary keys get slice 0."""
        out = df
        for name, table in zip(self.columns, self.levels):
            # a row per hot key, about MOST_CUTS cuts in all
            out = out.join(F.broadcast(table), list(self.keys), "left").withColumn(
                name, _slice_number(F.struct(F.col(position).alias("p"), F.col(tie).alias("t")))
            ).drop("_cuts")
        return out


def _slice_number(at: Column) -> Column:
    """One more than the cuts up to and with a row, by binary search."""
    cuts = F.col("_cuts")

    def step(passed: Column, width: Column) -> Column:
        further = passed + width
        return F.when(
            (further <= F.size(cuts)) & (F.get(cuts, further - 1) <= at), further
        ).otherwise(passed)

    passed = F.aggregate(F.array(*[F.lit(w) for w in _STEPS]), F.lit(0), step)
    return F.when(cuts.isNull(), F.lit(0)).otherwise(passed + 1).cast("bigint")


def has_hot_key(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether any key has more than ``hot_rows`` rows; reads the keys only."""
    return _hot_quota(df, keys, hot_rows) is not None


def _hot_quota(df: DataFrame, keys: list[str], hot_rows: int) -> int | None:
    """Rows above which a key is cut, None where no key has as many.

    ``hot_rows``, or more where the whole table at that size would need more
    than ``MOST_CUTS`` cuts.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, every = counts.agg(F.max("_n"), F.sum("_n")).first()
    quota = max(hot_rows, -(-(every or 0) * SLICES_PER_QUOTA // MOST_CUTS))
    return quota if (most or 0) > quota else None


def measure_slices(
    df: DataFrame,
    keys: list[str],
    position: str,
    tie: str,
    hot_rows: int | None = HOT_ROWS,
) -> Slices:
    """Find the hot groups of ``keys`` and decide how to cut them.

    ``df`` needs only the key, position and tie columns and may be a superset
    of the rows that are windowed later: the cuts change the plan, never the
    result. Cuts are quantiles of ``(position, tie)`` among rows sampled by hash,
    so a skewed position is cut as evenly as any; only rows equal in both stay
    together. A group with a null key stays one window.
    """
    hot_rows = _hot_quota(df, keys, hot_rows)
    if hot_rows is None:
        return Slices(tuple(keys))
    share = min(1.0, SLICES_PER_QUOTA * SAMPLES_PER_SLICE / hot_rows)
    every = max(1, int(hot_rows * share / SLICES_PER_QUOTA))
    rows = df.select(*keys, F.struct(F.col(position).alias("p"), F.col(tie).alias("t")).alias("_at"))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    drawn = F.pmod(F.xxhash64(*keys, "_at"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    cuts = (
        rows.filter(drawn)
        .join(F.broadcast(hot.select(*keys)), keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_all"))
        .select(
            *keys,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / every).cast("int")),
                lambda i: F.get("_all", i * every),
            ).alias("_cuts"),
        )
    )
    return Slices(tuple(keys), (pinned(cuts),))


def running_sums(
    df: DataFrame,
    keys: list[str],
    position: str,
    tie: str,
    measures: dict[str, Column],
    *,
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
    slices: Slices | None = None,
) -> DataFrame:
    """Add a running sum for each measure, per key, in (position, tie) order.

    Both are of any types that have an order, and together fix a row's place
    within its key.
    """
    slices = slices or measure_slices(df, keys, position, tie, hot_rows)
    last = 0 if inclusive else -1
    staged = slices.apply(df, position, tie).withColumns(
        {f"_m_{name}": expr for name, expr in measures.items()}
    )
    window = (
        Window.partitionBy(*slices.group)
        .orderBy(position, tie)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    local = staged.withColumns(
        {name: F.coalesce(F.sum(f"_m_{name}").over(window), F.lit(0)) for name in measures}
    )
    if slices.any:
        before = carry_totals(staged, slices, {n: F.col(f"_m_{n}") for n in measures})
        local = local.join(before, slices.group, "left").withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in measures}
        )
        local = local.drop(*[f"_before_{n}" for n in measures])
    return local.drop(*slices.columns, *[f"_m_{n}" for n in measures])


def carry_totals(df: DataFrame, slices: Slices, measures: dict[str, Column]) -> DataFrame:
    """Per slice of a hot key, the totals of the slices before it.

    One row per slice, so the window here runs over slice totals, not rows.
    """
    totals = (
        df.filter(F.col("_slice1") > 0)
        .groupBy(*slices.group)
        .agg(*[F.sum(expr).alias(f"_t_{name}") for name, expr in measures.items()])
    )
    window = (
        Window.partitionBy(*slices.keys)
        .orderBy(*slices.columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *slices.group,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(window), F.lit(0)).alias(f"_before_{name}")
            for name in measures
        ],
    )


def row_numbers(
    df: DataFrame,
    keys: list[str],
    position: str,
    tie: str,
    name: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number`` per key that also holds for hot keys."""
    return running_sums(
        df, keys, position, tie, {name: F.lit(1).cast("bigint")}, hot_rows=hot_rows
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark limits each map task to one row per key before the shuffle
    (WindowGroupLimit), so copies of one key never meet in a single task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_first", F.row_number().over(window))
        .filter(F.col("_first") == 1)
        .drop("_first")
    )


def evaluated_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that later filters must not copy into themselves.

    The optimizer pushes filters through projections by repeating their
    expressions, but not through a generator.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))
