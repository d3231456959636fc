"""The event log as tables: decode, encode, export, import, offsets and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens import schemas
from orderlens.functions.clock import iso_utc, parse_iso_utc
from orderlens.plans.running import HOT_ROWS, evaluated_once, row_numbers
from orderlens.sources.json_array import read_array_texts


def read_kafka_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic as a stream from the earliest offset; the checkpoint of the
    query that reads it is the group's committed position."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    return reader.load().select(
        "topic", "partition", "offset", F.col("key").cast("string"), F.col("value").cast("string")
    )


def decode_envelopes(records: DataFrame, value: str = "value") -> DataFrame:
    """Parse envelope text. Adds the envelope columns and ``reject_reason``,
    null for a good record; one pass serves the good rows and the quarantine."""
    # rendered as JSON text of the payload object, decoded per event type later
    text = F.col(value)
    parsed = F.from_json(
        text,
        T.StructType([*schemas.ENVELOPE.fields, T.StructField("_bad", T.StringType())]),
        {"columnNameOfCorruptRecord": "_bad"},
    )
    out = evaluated_once(records, "_e", parsed).select(
        *records.columns,
        F.col("_e.event_id").alias("event_id"),
        F.col("_e.event_type").alias("event_type"),
        parse_iso_utc(F.col("_e.occurred_at")).alias("occurred_at"),
        F.col("_e.correlation_id").alias("correlation_id"),
        F.coalesce(
            F.col("_e.order_id"), F.get_json_object(F.col("_e.payload"), "$.order_id")
        ).alias("order_id"),
        F.coalesce(F.col("_e.schema_version"), F.lit(1)).alias("schema_version"),
        F.col("_e.payload").alias("payload"),
        (
            text.isNull()
            | F.col("_e").isNull()
            | F.col("_e._bad").isNotNull()
            | ~F.ltrim(text).startswith("{")
        ).alias("_broken"),
        F.col("_e.occurred_at").alias("_when"),
    )
    reason = (
        F.when(F.col("_broken"), "not a JSON object")
        .when(F.coalesce(F.col("event_id"), F.lit("")) == "", "no event_id")
        .when(F.col("event_type").isNull(), "no event_type")
        .when(~F.col("event_type").isin(*schemas.EVENT_TYPES), "unknown event_type")
        .when(F.col("_when").isNotNull() & F.col("occurred_at").isNull(), "bad occurred_at")
    )
    return out.withColumn("reject_reason", reason).drop("_broken", "_when")


def decode_payload(envelopes: DataFrame, event_type: str) -> DataFrame:
    """The events of one type with their payload as a typed struct."""
    return envelopes.filter(F.col("event_type") == event_type).withColumn(
        "body", F.from_json("payload", schemas.PAYLOADS[event_type])
    )


def events_by_type(envelopes: DataFrame, handlers: dict) -> dict[str, DataFrame]:
    """One branch per handled type; other types are ignored."""
    return {
        name: handler(envelopes.filter(F.col("event_type") == name))
        for name, handler in handlers.items()
    }


def envelope_json(payload: Column) -> Column:
    """Canonical compact JSON of the envelope columns, nulls kept.

    ``payload`` is a struct; ``order_id`` is lifted out of it when the
    envelope has none.
    """
    return F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("event_type"),
            iso_utc(F.col("occurred_at")).alias("occurred_at"),
            F.coalesce(F.col("correlation_id"), F.col("order_id")).alias("correlation_id"),
            F.coalesce(F.col("order_id"), payload.getField("order_id")).alias("order_id"),
            F.col("offset"),
            F.col("partition"),
            F.lit(1).alias("schema_version"),
            payload.alias("payload"),
        ),
        {"ignoreNullFields": "false"},
    )


def export_line(topic: Column, key: Column, envelope: Column) -> Column:
    """A console-consumer export line: the envelope as a base64 payload."""
    body = F.regexp_replace(F.base64(F.encode(envelope, "UTF-8")), "[\r\n]", "")
    return F.to_json(F.struct(topic.alias("topic"), key.alias("key"), body.alias("payload")))


def write_export(records: DataFrame, line: str, path: str) -> None:
    records.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def unwrap_export(records: DataFrame, value: str = "value") -> DataFrame:
    """Turn export lines into envelope text.

    A line is an envelope, or a wrapper whose ``payload`` (or ``value``) is the
    envelope as text or as base64. What decodes to JSON was base64.
    """
    line = F.col(value)
    parsed = F.from_json(line, "event_id string, payload string, value string")
    wrapper = evaluated_once(records, "_w", parsed).withColumn(
        "_inner", F.coalesce(F.col("_w.payload"), F.col("_w.value"))
    )
    bytes_ = F.try_to_binary(F.col("_inner"), F.lit("base64"))
    opened = evaluated_once(wrapper, "_text", F.try_validate_utf8(bytes_.cast("string")))
    content = F.when(F.ltrim("_text").rlike(r"^[\{\[]"), F.col("_text")).otherwise(F.col("_inner"))
    as_is = F.col("_w.event_id").isNotNull() | F.col("_inner").isNull()
    envelope = F.when(as_is, line).otherwise(content)
    return evaluated_once(opened, "_envelope", envelope).drop(
        value, "_w", "_inner", "_text"
    ).withColumnRenamed("_envelope", value)


def read_export(spark: SparkSession, path: str, shape: str = "lines") -> DataFrame:
    """An exported log: ``lines`` (one record a line, either kind) or ``array``
    (each file is one JSON array, which many tasks read)."""
    if shape == "lines":
        lines = spark.read.text(path)
    elif shape == "array":
        lines = read_array_texts(spark, path)
    else:
        raise ValueError(f"unknown export shape {shape!r}")
    return decode_envelopes(unwrap_export(lines.filter(F.trim("value") != "")))


def assign_offsets(
    records: DataFrame, position: str, tie: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number the records of each partition from 0 in (position, tie) order.

    A log has few partitions, so each is a hot key and is sliced.
    """
    numbered = row_numbers(records, ["topic", "partition"], position, tie, "offset", hot_rows)
    return numbered.withColumn("offset", F.col("offset") - 1)


def partition_for(key: Column, partitions: int = schemas.PARTITIONS) -> Column:
    return (F.crc32(F.encode(key.cast("string"), "UTF-8")) % partitions).cast("int")


def replay(log: DataFrame, from_offset: int = 0) -> DataFrame:
    """Every record from an offset on, whatever any group has committed."""
    return log.filter(F.col("offset") >= from_offset).orderBy("topic", "partition", "offset")


def end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def partition_lag(
    ends: DataFrame, commits: DataFrame, groups: DataFrame | None = None
) -> DataFrame:
    """Per group and partition, records not yet committed; no commit counts as 0.

    ``commits`` is ``consumer_group, topic, partition, committed``. ``groups``
    (``consumer_group, topic``) names those that may not have committed at all.
    """
    if groups is None:
        groups = commits.select("consumer_group", "topic").distinct()
    return (
        ends.join(groups, "topic")
        .join(commits, ["consumer_group", "topic", "partition"], "left")
        .select(
            "consumer_group",
            "topic",
            "partition",
            F.greatest(
                F.lit(0), F.col("end_offset") - F.coalesce(F.col("committed"), F.lit(0))
            ).alias("lag"),
        )
    )


def group_lag(ends: DataFrame, commits: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    return (
        partition_lag(ends, commits, groups)
        .groupBy("consumer_group", "topic")
        .agg(F.sum("lag").alias("lag"))
    )
