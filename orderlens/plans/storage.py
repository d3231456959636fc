"""Cut lineage reliably: results that are used again live in shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only where the session
    names none, as in tests, one beside the warehouse is set: both are storage
    that the driver and all executors reach."""
    named = spark.conf.get(_SETTING, None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, written once to reliable storage.

    Survives the loss of executors and keeps iterative plans short.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder.

    Unlike ``pinned`` a later plan knows how large they are, and reads the columns
    that it needs.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
