import pytest
from pyspark.sql import functions as F

from orderlens.sources import log
from orderlens.sources.topic import Topic
from orderlens.streaming.run import batch_writer


def records(spark, ids):
    rows = spark.createDataFrame([(i, i // 10) for i in ids], "id bigint, t bigint")
    return rows.withColumn("partition", (F.col("id") % 3).cast("int"))


def positions(spark, path):
    rows = spark.read.parquet(path).collect()
    return sorted((r.partition, r.offset, r.id) for r in rows)


def expected(ids):
    return sorted((i % 3, n, i) for p in range(3) for n, i in enumerate([x for x in ids if x % 3 == p]))


def test_a_group_resumes_at_its_committed_offset(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "log"), "orders")
    out = str(tmp_path / "out")
    assert topic.consume("g", batch_writer(out)) == 0
    topic.append(records(spark, range(40)), "t", "id")
    assert topic.consume("g", batch_writer(out), limit=5, batches=2) == 2
    assert {r.partition: r.committed for r in topic.committed_offsets("g").collect()} == {0: 10, 1: 10, 2: 10}
    again = Topic(spark, str(tmp_path / "log"), "orders")
    again.append(records(spark, range(40, 70)), "t", "id")
    assert again.consume("g", batch_writer(out), limit=5) == 3
    assert positions(spark, out) == expected(range(70))
    assert again.next_batch("g") is None


def test_a_batch_that_failed_is_given_again_unchanged(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "log"), "orders")
    out = str(tmp_path / "out")
    topic.append(records(spark, range(20)), "t", "id")
    write = batch_writer(out)

    def fails(df, number):
        write(df, number)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        topic.consume("g", fails, limit=4)
    assert topic.committed_offsets("g").count() == 0
    topic.append(records(spark, range(20, 40)), "t", "id")
    assert topic.next_batch("g").ranges == ((0, 0, 4), (1, 0, 4), (2, 0, 4))
    topic.consume("g", write)
    assert positions(spark, out) == expected(range(40))


def test_an_append_counts_once_its_ends_are_written(spark, tmp_path):
    path = str(tmp_path / "log")
    topic = Topic(spark, path, "orders")
    topic.append(records(spark, range(9)), "t", "id")
    # an append that was lost half-way
    lost = records(spark, range(100, 130)).withColumn("offset", F.lit(3).cast("bigint"))
    lost.write.partitionBy("partition").parquet(f"{path}/records/append=1")
    out = str(tmp_path / "out")
    topic.consume("g", batch_writer(out))
    assert topic.append(records(spark, range(9, 18)), "t", "id") == 1
    topic.consume("g", batch_writer(out))
    assert positions(spark, out) == expected(range(18))


def test_groups_are_apart_and_lag_counts_those_that_never_began(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "log"), "orders")
    topic.append(records(spark, range(30)), "t", "id")
    topic.consume("a/b", lambda df, n: None, limit=4, batches=1)
    topic.consume("c", lambda df, n: None)
    names = [("a/b", "orders"), ("c", "orders"), ("d", "orders")]
    groups = spark.createDataFrame(names, "consumer_group string, topic string")
    lag = log.group_lag(topic.end_offsets(), topic.committed_offsets("a/b", "c", "d"), groups)
    assert {r.consumer_group: r.lag for r in lag.collect()} == {"a/b": 18, "c": 0, "d": 30}


def test_a_batch_opens_only_the_appends_it_needs(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "log"), "orders")
    for start in range(0, 60, 12):
        topic.append(records(spark, range(start, start + 12)), "t", "id")
    topic.consume("g", lambda df, n: None, limit=8, batches=1)
    df = topic.read(topic.next_batch("g", limit=4))
    assert {f.split("append=")[1][0] for f in df.inputFiles()} == {"2"}
    assert df.count() == 12


def test_new_columns_missing_partitions_and_empty_appends(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "log"), "orders")
    topic.append(records(spark, []), "t", "id")
    topic.append(records(spark, [0]).withColumn("partition", F.lit(None).cast("int")), "t", "id")
    topic.append(records(spark, [3]).withColumn("note", F.lit("x")), "t", "id")
    df = topic.read(topic.next_batch("g"))
    got = sorted((r.partition, r.offset, r.id, r.note) for r in df.collect())
    assert got == [(0, 0, 0, None), (0, 1, 3, "x")]


def test_a_batch_does_not_read_the_offsets_of_those_before_it(spark, tmp_path, monkeypatch):
    reads = []
    plain = Topic._small
    monkeypatch.setattr(Topic, "_small", lambda *a: reads.append(1) or plain(*a))
    spent = []
    for limit in (10, 3):
        topic = Topic(spark, str(tmp_path / f"log-{limit}"), "orders")
        topic.append(records(spark, range(40)), "t", "id")
        topic.append(records(spark, range(40, 60)), "t", "id")
        out = str(tmp_path / f"out-{limit}")
        reads.clear()
        assert topic.consume("g", batch_writer(out), limit=limit) == (2 if limit == 10 else 7)
        spent.append(len(reads))
        assert positions(spark, out) == expected(range(60))
    assert spent[0] == spent[1]
