"""Sharding by extendible hashing: every shard fits a byte limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm import extendible
from orderlens.llm.common import code_of, text_or_empty, whole_row, written


def assign_shards(docs: DataFrame, limit: int) -> DataFrame:
    """One row per document: its shard and what the shard holds.

    The hash covers id and text, so equal texts spread. Null counts as empty.
    Only rows equal in both share a hash; where they, or one text, exceed
    ``limit`` by themselves, their shard of all hash bits is the one kind
    above the limit. An empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are not read.

    Returns ``doc_id, n_bytes, shard`` (the prefix as bits, empty for the
    whole table), ``depth, shard_bytes, shard_docs``.
    """
    sizes = written(
        docs.select(
            "doc_id",
            code_of("doc_id", "text").alias("code"),
            F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"),
        ),
        "sizes",
    )
    directory = extendible.build(sizes, limit, size="n_bytes")
    placed = directory.find(sizes)
    totals = placed.groupBy("depth", "prefix").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs")
    )
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(bin(prefix), depth, '0')")
    )
    return placed.join(written(totals, "shards"), ["depth", "prefix"]).select(
        "doc_id", "n_bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_docs"
    )


def write_shards(docs: DataFrame, limit: int, path: str, folder: str = "shard") -> None:
    """Write whole rows, each shard in a folder of its own below ``path``.

    ``folder`` names the folders and must not be a column. An empty table writes
    no shard.
    """
    if folder in docs.columns:
        raise ValueError(f"the table has a column {folder}; name the folders otherwise")
    coded = docs.select(
        whole_row(docs),
        code_of("doc_id", "text").alias("code"),
        F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"),
    )
    directory = extendible.build(coded.select("code", "n_bytes"), limit, size="n_bytes")
    shard = F.concat_ws("-", F.col("depth"), F.col("prefix")).alias(folder)
    (
        directory.find(coded)
        .select("row.*", shard)
        .repartition(folder)
        .write.partitionBy(folder)
        .parquet(path)
    )
