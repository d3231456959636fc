"""A topic kept as Parquet files: appended to, subscribed to by groups, no server.

A topic is a folder that Spark can read and write. Every step writes a folder of
its own, so a step that is repeated after a failure replaces itself:

* ``records/append=N``: the records of one append, by partition;
* ``ends/append=N``: where each partition began and ended in it. An append counts
  once this is written; before that nobody sees its records;
* ``groups/<group>/planned/batch=N`` and ``.../done/batch=N``: from which offset to
  which a group's batch goes, and that it was handled. A group's committed offset
  is the end of its last batch that was done.

A topic has one writer at a time, and a group one consumer. So a consumer reads
these tables when it begins and when it has handled what they told, not for every
batch: a batch costs its records and two small files, however many came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.plans.storage import pinned
from orderlens.sources.log import assign_offsets

_RANGE = "partition int, start_offset bigint, end_offset bigint"


@dataclass(frozen=True)
class Batch:
    """What a group handles next: ``(partition, from, up to)`` of each partition
    that has records for it."""

    number: int
    ranges: tuple[tuple[int, int, int], ...]


@dataclass
class _Progress:
    """Where a consumer of a group is: the batch that is next, what it has committed
    of each partition, and what it read of the topic: the appends that it has not
    handled (``append, partition, from, up to``), and their records once opened."""

    number: int
    committed: dict[int, int]
    planned: tuple[tuple[int, int, int], ...]
    appends: list[tuple[int, int, int, int]] = field(default_factory=list)
    opened: dict[int, DataFrame] = field(default_factory=dict)


class Topic:
    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self._spark, self._path, self.name = spark, path.rstrip("/"), name

    def append(self, records: DataFrame, position: str, tie: str) -> int:
        """Number the records of each partition after those already there, in
        (position, tie) order, and write them. Returns the number of the append.

        ``records`` has ``partition`` and any other columns but ``topic`` and
        ``offset``. Without a partition a record goes to partition 0.
        """
        number = self._last(f"{self._path}/ends", "append") + 1
        before = self.end_offsets().select("partition", F.col("end_offset").alias("_from"))
        base = pinned(
            records.withColumn("topic", F.lit(self.name)).withColumn(
                "partition", F.coalesce(F.col("partition").cast("int"), F.lit(0))
            )
        )
        numbered = assign_offsets(base, position, tie)
        # a row per partition of the topic
        placed = numbered.join(F.broadcast(before), "partition", "left").withColumn(
            "offset", F.col("offset") + F.coalesce("_from", F.lit(0))
        )
        folder = f"{self._path}/records/append={number}"
        (
            placed.drop("topic", "_from")
            .repartitionByRange("partition", "offset")
            .sortWithinPartitions("partition", "offset")
            .write.mode("overwrite")
            .partitionBy("partition")
            .parquet(folder)
        )
        # an append without records has no files to take a schema from
        numbers = self._spark.read.schema("offset bigint, partition int").parquet(folder)
        written = numbers.groupBy("partition").agg(
            F.min("offset").alias("start_offset"), (F.max("offset") + 1).alias("end_offset")
        )
        self._write_small(written, f"{self._path}/ends/append={number}")
        return number

    def end_offsets(self) -> DataFrame:
        """The offset that each partition's next record will have."""
        return (
            self._small(f"{self._path}/ends", "append")
            .groupBy("topic", "partition")
            .agg(F.max("end_offset").alias("end_offset"))
        )

    def committed_offsets(self, *groups: str) -> DataFrame:
        """Up to where each group has handled each partition it has begun."""
        done = [
            self._small(f"{self._group(g)}/done", "batch")
            .groupBy("topic", "partition")
            .agg(F.max("end_offset").alias("committed"))
            .select(F.lit(g).alias("consumer_group"), "topic", "partition", "committed")
            for g in groups
        ]
        return reduce(DataFrame.unionByName, done)

    def next_batch(self, group: str, limit: int | None = None) -> Batch | None:
        """What the group handles next, at most ``limit`` records a partition;
        None when it has handled everything.

        The batch is written down first. One that was not done is given again
        with the same number and the same records, whatever came in since.
        """
        return self._next(group, self._progress(group), limit)

    def _progress(self, group: str) -> _Progress:
        folder = self._group(group)
        done = self._small(f"{folder}/done", "batch").groupBy("partition")
        # a row per partition
        rows = done.agg(F.max("end_offset").alias("to"), F.max("batch").alias("batch")).collect()
        number = max((r.batch for r in rows), default=-1) + 1
        planned = self._small(f"{folder}/planned", "batch").filter(F.col("batch") == number).collect()
        return _Progress(
            number,
            {r.partition: r.to for r in rows},
            tuple(sorted((r.partition, r.start_offset, r.end_offset) for r in planned)),
        )

    def _look(self, progress: _Progress) -> None:
        """What was appended that the group has not handled."""
        ends = self._small(f"{self._path}/ends", "append")
        for partition, committed in progress.committed.items():
            ends = ends.filter((F.col("partition") != partition) | (F.col("end_offset") > committed))
        rows = ends.select("append", "partition", "start_offset", "end_offset").collect()
        progress.appends = sorted(tuple(r) for r in rows)

    def _next(self, group: str, progress: _Progress, limit: int | None) -> Batch | None:
        if not progress.planned:
            ranges = self._waiting(progress, limit)
            if not ranges:
                self._look(progress)
                ranges = self._waiting(progress, limit)
            if not ranges:
                return None
            planned = f"{self._group(group)}/planned/batch={progress.number}"
            self._write_small(self._ranges(ranges), planned)
            progress.planned = tuple(ranges)
        return Batch(progress.number, progress.planned)

    @staticmethod
    def _waiting(progress: _Progress, limit: int | None) -> list[tuple[int, int, int]]:
        ends: dict[int, int] = {}
        for _, partition, _, end in progress.appends:
            ends[partition] = max(end, ends.get(partition, 0))
        ranges = []
        for partition, end in sorted(ends.items()):
            start = progress.committed.get(partition, 0)
            upto = end if limit is None else min(end, start + limit)
            if start < upto:
                ranges.append((partition, start, upto))
        return ranges

    def read(self, batch: Batch) -> DataFrame:
        """The records of a batch. Only appends that hold some of them are opened,
        so what is read does not grow with the topic."""
        begun = _Progress(batch.number, {p: start for p, start, _ in batch.ranges}, batch.ranges)
        self._look(begun)
        return self._read(batch, begun)

    def _read(self, batch: Batch, progress: _Progress) -> DataFrame:
        wanted = {p: (start, end) for p, start, end in batch.ranges}
        held = {
            append
            for append, p, start, end in progress.appends
            if p in wanted and start < wanted[p][1] and end > wanted[p][0]
        }
        # files are listed and their schema is read once; appends left behind are let go
        opened = {n: df for n, df in progress.opened.items() if n in held}
        for n in sorted(held - set(opened)):
            # the folder is no column of the records
            folder = f"{self._path}/records/append={n}"
            opened[n] = self._spark.read.option("basePath", folder).parquet(folder)
        progress.opened = opened
        parts = [opened[n] for n in sorted(opened)]
        records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        inside = [
            (F.col("partition") == p) & (F.col("offset") >= start) & (F.col("offset") < end)
            for p, start, end in batch.ranges
        ]
        return records.filter(reduce(or_, inside)).withColumn("topic", F.lit(self.name))

    def commit(self, group: str, batch: Batch) -> None:
        """The group has handled the batch."""
        rows = self._ranges(batch.ranges)
        self._write_small(rows, f"{self._group(group)}/done/batch={batch.number}")

    def consume(
        self,
        group: str,
        handle: Callable[[DataFrame, int], None],
        limit: int | None = None,
        batches: int | None = None,
    ) -> int:
        """Hand the group what it has not handled, batch by batch, until it has
        caught up (or for so many batches). Returns how many there were.

        A batch is committed after ``handle`` returns. If that fails, it is given
        again with its number, so a handler that replaces what it wrote for that
        number (``streaming.run.batch_writer``) has each record once.
        """
        handled = 0
        if batches is not None and batches < 1:
            return handled
        progress = self._progress(group)
        if progress.planned:
            self._look(progress)
        while batches is None or handled < batches:
            batch = self._next(group, progress, limit)
            if batch is None:
                break
            handle(self._read(batch, progress), batch.number)
            self.commit(group, batch)
            progress.number, progress.planned = batch.number + 1, ()
            progress.committed |= {p: end for p, _, end in batch.ranges}
            handled += 1
        return handled

    def _group(self, group: str) -> str:
        return f"{self._path}/groups/{quote(group, safe='')}"

    def _small(self, path: str, step: str) -> DataFrame:
        """A table of offsets; without rows before its first step."""
        schema = f"topic string, {_RANGE}, {step} bigint"
        try:
            return self._spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        return self._spark.createDataFrame([], schema)

    def _last(self, path: str, step: str) -> int:
        last = self._small(path, step).agg(F.max(step)).first()[0]
        return -1 if last is None else last

    def _ranges(self, ranges: Iterable[tuple[int, int, int]]) -> DataFrame:
        # known to the planner as a table, so writing it starts no Python worker
        rows = ", ".join(f"({p}, {start}L, {end}L)" for p, start, end in ranges)
        return self._spark.sql(f"SELECT * FROM VALUES {rows} AS r(partition, start_offset, end_offset)")

    def _write_small(self, rows: DataFrame, folder: str) -> None:
        # one file: it is there as a whole or not at all
        rows.select(
            F.lit(self.name).alias("topic"), "partition", "start_offset", "end_offset"
        ).coalesce(1).write.mode("overwrite").parquet(folder)
