"""Extendible hashing as Spark jobs: a directory of hash prefixes.

A bucket is a prefix of the hash. A bucket over the limit is split on one more
bit, until every bucket fits. One histogram over ``STEP`` bits decides all
splits of these bits at once; only prefixes still over the limit are read again
for the next bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import CODE_BITS, written

STEP = 12


@dataclass(frozen=True)
class Directory:
    """``slots[i]`` maps each used prefix of ``STEP * (i + 1)`` bits to its
    bucket (depth and prefix), null where the bucket is deeper."""

    slots: tuple[DataFrame, ...]

    def find(self, df: DataFrame, code: str = "code") -> DataFrame:
        """Add ``depth`` and ``prefix`` of the bucket of each row."""
        out = df.withColumns(
            {"depth": F.lit(None).cast("int"), "prefix": F.lit(None).cast("bigint")}
        )
        for i, table in enumerate(self.slots):
            slot = F.shiftright(F.col(code), CODE_BITS - STEP * (i + 1))
            out = (
                out.withColumn("_slot", slot)
                .join(table, "_slot", "left")
                .withColumns(
                    {
                        "depth": F.coalesce("depth", "_depth"),
                        "prefix": F.coalesce("prefix", "_prefix"),
                    }
                )
                .drop("_slot", "_depth", "_prefix")
            )
        return out

    def deepest(self) -> int:
        return max((t.agg(F.max("_depth")).first()[0] or 0) for t in self.slots)


def build(sizes: DataFrame, limit: int, code: str = "code", size: str = "size") -> Directory:
    """Split until every bucket holds at most ``limit``, or its rows share a hash.

    ``code`` has ``CODE_BITS`` bits. Each level has one partial aggregation to
    at most 2**STEP rows per prefix that is still too large.
    """
    slots: list[DataFrame] = []
    rest = sizes.select(F.col(code).alias("_code"), F.col(size).alias("_size"))
    for bits in range(STEP, CODE_BITS + 1, STEP):
        counted = written(
            rest.groupBy(F.shiftright("_code", CODE_BITS - bits).alias("_slot")).agg(
                F.sum("_size").alias("_total")
            ),
            "slots",
        )
        least = 0 if bits == STEP else bits - STEP + 1
        depths = F.explode(F.sequence(F.lit(least), F.lit(bits)))
        nodes = (
            counted.select("_slot", "_total", depths.alias("_depth"))
            .withColumn("_prefix", F.expr(f"shiftright(_slot, {bits} - _depth)"))
            .groupBy("_depth", "_prefix")
            .agg(F.sum("_total").alias("_total"))
        )
        fits = F.col("_total") <= limit
        if bits == CODE_BITS:
            fits = fits | (F.col("_depth") == CODE_BITS)
        chosen = (
            counted.select("_slot", depths.alias("_depth"))
            .withColumn("_prefix", F.expr(f"shiftright(_slot, {bits} - _depth)"))
            .join(nodes.filter(fits).drop("_total"), ["_depth", "_prefix"])
            .groupBy("_slot")
            .agg(F.min(F.struct("_depth", "_prefix")).alias("_b"))
        )
        table = written(
            counted.join(chosen, "_slot", "left").select("_slot", "_b._depth", "_b._prefix"),
            "directory",
        )
        slots.append(table)
        if table.filter(F.col("_depth").isNull()).isEmpty():
            break
        rest = rest.withColumn("_slot", F.shiftright("_code", CODE_BITS - bits)).join(
            table.filter(F.col("_depth").isNull()).select("_slot"), "_slot", "left_semi"
        ).drop("_slot")
    return Directory(tuple(slots))
