"""Mixing sources to target weights by hash thresholds, without sorting rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import CODE_BITS, code_of, whole_row, word_count, written

STEP = 20


def capped_shares(sources: DataFrame, total: float, weights: Sequence[float], most: float) -> DataFrame:
    """Share ``total`` of all sizes among sources by weight, none above ``most``
    times its size.

    ``sources`` has ``source_key, source, source_size``; weights repeat over
    sources by code point, null last. In order of cap over weight, the level
    rises while sources meet their caps and falls after, so the level at which
    all is shared is the highest. One row per source runs through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rising = Window.orderBy("fill", "rank")
    upto = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    return (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumns(
            {
                "caps": F.sum("cap").over(upto) - F.col("cap"),
                "taken_weight": F.sum("weight").over(upto) - F.col("weight"),
                "weights": F.sum("weight").over(whole),
                "sizes": F.sum("source_size").over(whole),
            }
        )
        .withColumn(
            "level",
            F.max(
                (F.col("sizes") * F.lit(float(total)) - F.col("caps"))
                / (F.col("weights") - F.col("taken_weight"))
            ).over(whole),
        )
        .select(
            "source_key",
            "source_size",
            F.least("cap", F.col("weight") * F.col("level")).alias("target"),
        )
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which each source's budget is used up.

    ``rows``: ``source_key, code, size``; ``budgets``: ``source_key, part,
    budget``, where parts of one source are nested: all cut the same order.
    Sizes are summed by source and hash bucket; only the bucket in which a
    budget ends is read again, finer. Returns ``source_key, part, edge,
    edge_size, edge_budget``: codes below ``edge`` are in, those equal to it
    (one row, or copies of it) share ``edge_budget``. No row where the budget
    takes everything.
    """
    open_ = budgets.withColumn("_bucket", F.lit(0).cast("bigint"))
    for bits in range(STEP, CODE_BITS + 1, STEP):
        inside = F.shiftright("code", CODE_BITS - bits + STEP)
        left = rows
        if bits > STEP:
            at = open_.select("source_key", "_bucket").distinct()
            left = rows.withColumn("_bucket", inside).join(
                at, ["source_key", "_bucket"], "left_semi"
            )
        sums = left.groupBy(
            "source_key", F.shiftright("code", CODE_BITS - bits).alias("_next")
        ).agg(F.sum("size").alias("_size")).withColumn(
            "_bucket", F.shiftright("_next", STEP)
        )
        order = (
            Window.partitionBy("source_key", "part", "_bucket")
            .orderBy("_next")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        before = F.col("_upto") - F.col("_size")
        open_ = written(
            open_.join(sums, ["source_key", "_bucket"])
            .withColumn("_upto", F.sum("_size").over(order))
            .filter((before <= F.col("budget")) & (F.col("budget") < F.col("_upto")))
            .select(
                "source_key",
                "part",
                (F.col("budget") - before).alias("budget"),
                F.col("_next").alias("_bucket"),
                "_size",
            ),
            "edges",
        )
        edge = open_
        open_ = open_.drop("_size")
    return edge.select(
        "source_key",
        "part",
        F.col("_bucket").alias("edge"),
        F.col("_size").alias("edge_size"),
        F.col("budget").alias("edge_budget"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    split_edge: bool = True,
) -> DataFrame:
    """How many words of each document the mix takes.

    A source below its target repeats: each document is taken whole as often as
    the target holds the source, and once more where its hash is below the
    source's threshold. The one document at the threshold gives the words that
    are still missing; with ``split_edge`` off it is taken whole if at least
    half of it is missing. Copies that agree in id, source and text share their
    hash and what is missing.

    Null texts have no words; null is a source of its own, the last. Sources
    without words have target 0. An empty table gives no rows.

    Returns ``doc_id, size, source_size, target, taken, code, source``.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = written(
        docs.select(
            "doc_id",
            "source",
            key.alias("source_key"),
            code_of("doc_id", "source", "text").alias("code"),
            word_count().alias("size"),
        ),
        "mix",
    )
    sources = rows.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size")
    )
    targets = capped_shares(sources, total, weights, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = written(
        targets.withColumn("times", F.coalesce(times, F.lit(0)).cast("bigint")), "targets"
    )
    budgets = targets.filter(F.col("source_size") > 0).select(
        "source_key",
        F.lit(0).alias("part"),
        F.round(F.col("target") - F.col("times") * F.col("source_size"))
        .cast("bigint")
        .alias("budget"),
    )
    edges = thresholds(rows.select("source_key", "code", "size"), budgets)
    share = F.floor(F.col("size") * F.col("edge_budget") / F.col("edge_size")).cast("bigint")
    if not split_edge:
        share = F.when(2 * F.col("edge_budget") >= F.col("edge_size"), F.col("size")).otherwise(0)
    more = (
        F.when(F.col("edge").isNull(), F.when(F.col("budget") > 0, F.col("size")).otherwise(0))
        .when(F.col("code") < F.col("edge"), F.col("size"))
        .when(F.col("code") == F.col("edge"), share)
        .otherwise(0)
    )
    cuts = written(
        targets.join(budgets.drop("part"), "source_key", "left").join(
            edges.drop("part"), "source_key", "left"
        ),
        "cuts",
    )
    return rows.join(cuts, "source_key").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("times") * F.col("size") + more).cast("bigint").alias("taken"),
        "code",
        "source",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, whole, with all
    its columns. Rows that agree in id, source and text are taken alike; an empty
    table gives no rows."""
    taken = mix(docs, split_edge=False, **options)
    copies = taken.filter("taken > 0").select(
        "code", (F.col("taken") / F.col("size")).cast("int").alias("times")
    ).groupBy("code").agg(F.max("times").alias("times"))
    return (
        docs.select(whole_row(docs), code_of("doc_id", "source", "text").alias("code"))
        .join(copies, "code")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("row.*")
    )
