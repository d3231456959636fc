"""Start streams that catch up and end, with results in shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.plans.running import first_per_key
from orderlens.plans.storage import fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keep state on disk while queries start; needed for state processors."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def file_stream(
    spark: SparkSession, folder: str, glob: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema they have now."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def catch_up(
    stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Run an append stream until it has read everything; return what it wrote.

    The file sink and the checkpoint make each row arrive once, also when the
    run is repeated after a failure with the same two paths.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    checkpoint = checkpoint or fresh_path(spark, f"{name}-checkpoint")
    with rocksdb_state(spark):
        query = (
            stream.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .format("parquet")
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def catch_up_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Run a stream until it has read everything, batch by batch."""
    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder; a repeated batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def effect_once_writer(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Like ``batch_writer``, and leaves out keys an earlier batch has written.

    Redelivered events have no second effect however late they come. Reads the
    ids of all earlier batches; a stream of its own is better off with
    ``apply_once``.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key])
        if batch_id > 0:
            past = spark.read.parquet(path)
            applied = past.filter(F.col("batch") < batch_id).select(key)
            fresh = fresh.join(applied, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


#: RocksDB writes the changes of a batch, not whole files of state, before it ends.
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def apply_once(
    stream: DataFrame,
    key: str,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> list[dict]:
    """Hand each key to ``write`` once, however late or often it comes again.

    The keys seen are state, looked up one by one: a batch reads and writes as
    much as it has rows, not what was applied before it. Only a task that takes a
    partition of state over loads that partition. ``write`` must replace what an
    earlier try of the same batch wrote (``batch_writer`` does); keys of a batch
    that failed count as unseen when it is repeated. Without a key a row is
    dropped, since nobody could tell it from a copy. Returns what each batch read
    and kept.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_CHANGELOG, None)
    spark.conf.set(_CHANGELOG, "true")
    try:
        with rocksdb_state(spark):
            query = (
                stream.filter(F.col(key).isNotNull())
                .dropDuplicates([key])
                .writeStream.outputMode("append")
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
            query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_CHANGELOG)
        else:
            spark.conf.set(_CHANGELOG, before)
    return [
        {
            "batch": p["batchId"],
            "rows": p["numInputRows"],
            "fresh": sum(o["numRowsUpdated"] for o in p["stateOperators"]),
            "seen": sum(o["numRowsTotal"] for o in p["stateOperators"]),
            "state_bytes_read": sum(
                o["customMetrics"].get("rocksdbTotalBytesRead", 0) for o in p["stateOperators"]
            ),
        }
        for p in query.recentProgress
    ]


def latest_rows(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batch folders."""
    return first_per_key(spark.read.parquet(path), keys, [F.desc("batch")]).drop("batch")
