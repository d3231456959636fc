"""The named queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (
    chat_format,
    exact_dedup,
    fingerprints,
    language,
    license_scan,
    mixing,
    near_dedup,
    packing,
    pii,
    repair,
    sharding,
    suffix_dedup,
    whitening,
)
from orderlens.llm.common import conversations, documents, embeddings

Query = Callable[[SparkSession, str], DataFrame]

SHARD_BYTES = 16 << 20

_BLANKS = r"[\x20\x09-\x0D]"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_SHA = f"sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g'))"


def _code(*columns: str) -> str:
    parts = ", ".join(f"coalesce({c}::VARCHAR, '')" for c in columns)
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
                  {_code('doc_id', 'source', 'text')} AS code FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
f AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
             source_size * 2.0::DOUBLE AS cap FROM w),
g AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
             sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER before, 0) AS caps,
             coalesce(sum(weight) OVER before, 0) AS taken_weight
      FROM f WINDOW before AS (ORDER BY cap / weight, place
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, max((total - caps) / (weights - taken_weight)) OVER () AS level FROM g),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM h),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times
      FROM t),
c AS (SELECT *, round(target - times * source_size)::BIGINT AS budget FROM b),
r AS (SELECT d.*, c.source_size, c.target, c.times, c.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.code) AS here
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (times * size + CASE WHEN upto <= budget THEN size WHEN upto - here >= budget THEN 0
                            ELSE size * (budget - (upto - here)) // here END)::BIGINT AS taken
FROM r
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir)).drop("kept")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_SHA} AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
      FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARD_BYTES)


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                  {_code('doc_id', 'text')} AS code FROM documents),
n AS (SELECT d.*, depth::INTEGER AS depth, code >> (60 - depth) AS prefix
      FROM d, (SELECT unnest(range(61)) AS depth)),
t AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
      FROM n GROUP BY ALL),
c AS (SELECT n.*, shard_bytes, shard_docs,
             row_number() OVER (PARTITION BY row ORDER BY depth) AS place
      FROM n JOIN t USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       depth, shard_bytes, shard_docs
FROM c WHERE place = 1
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def control_chat(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of the template."""
    return spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.format_chats(chats.unionByName(control_chat(spark))))


_CONTROL = r"[<\[]\\*(s>|/s>|INST\]|/INST\]|ROLE\]|TEXT\]|/TEXT\]|TURN\])"
_ESCAPED = "(length({0}) + len(regexp_extract_all({0}, '" + _CONTROL + "')))"
OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL
           SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
           FROM (SELECT unnest(range(2)) AS i)),
t AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS first,
             row_number() OVER w AS place
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({_ESCAPED.format('text')} + CASE
           WHEN NOT first THEN 6
           WHEN role = 'user' THEN 13
           WHEN role = 'assistant' THEN 7
           ELSE 19 + {_ESCAPED.format('role')} END)::BIGINT AS formatted_chars,
       sum(first::INTEGER)::BIGINT AS n_blocks
FROM t GROUP BY conv_id
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(embeddings(spark, sf_dir))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = conversations(spark, sf_dir)
    return repair.repair(repair.damaged(chats), every=chats)


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licenses": op3_licenses,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language": op6_language,
    "op7_near_dedup": op7_near_dedup,
    "op8_pack": op8_pack,
    "op9_shards": op9_shards,
    "op10_pii": op10_pii,
    "op11_chat_format": op11_chat_format,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_shards": OP9_SQL,
    "op11_chat_format": OP11_SQL,
}
