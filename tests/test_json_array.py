import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlens.sources import json_array

_SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def tiny_splits(spark):
    """Splits of some bytes, so that every kind of place is cut."""
    names = {_SPLIT: None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        for n, v in names.items():
            spark.conf.set(n, v or str(size))

    yield use
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def texts(spark, path):
    return [r.value for r in json_array.read_array_texts(spark, str(path)).collect()]


HARD = [
    {"a": 'quote " and \\ and \\" end\\', "b": ["]", "[", {"}": "{"}]},
    {},
    [],
    {"": "", "n": None, "x": [[1, 2], [3]]},
    {"text": "é𝄞漢\n\t" + "x" * 90},
    {"e": '\\\\"'},
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 61, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_gives_the_same_records(spark, tmp_path, tiny_splits, size, indent):
    (tmp_path / "a.json").write_text(json.dumps(HARD, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(HARD[:2], indent=indent))
    tiny_splits(size)
    got = sorted(json.dumps(json.loads(t)) for t in texts(spark, tmp_path))
    assert got == sorted(json.dumps(x) for x in HARD + HARD[:2])


_json = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(alphabet='"\\[]{},: aé', max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('"\\{]a', max_size=3), x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(records=st.lists(st.dictionaries(st.text('"\\}a', max_size=4), _json, max_size=3), max_size=6),
       size=st.integers(1, 40))
def test_random_arrays(spark, tmp_path_factory, tiny_splits, records, size):
    folder = tmp_path_factory.mktemp("arrays")
    (folder / "a.json").write_text(json.dumps(records))
    tiny_splits(size)
    got = sorted(json.dumps(json.loads(t), sort_keys=True) for t in texts(spark, folder))
    assert got == sorted(json.dumps(x, sort_keys=True) for x in records)


def test_other_elements_broken_and_empty_files(spark, tmp_path, tiny_splits):
    (tmp_path / "a.json").write_text('[1, "a{b", null, {"k": 1}, true]')
    (tmp_path / "b.json").write_text('{"k": 2}\n{"k": 3}')
    (tmp_path / "c.json").write_text('[{"k": 4}, {"k": "br')
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text("[]")
    tiny_splits(9)
    got = sorted(texts(spark, tmp_path))
    assert got[:4] == ['{"k": "br"', '{"k": 1}', '{"k": 2}', '{"k": 3}'] and got[4:] == ['{"k": 4}']


def test_many_splits_are_sorted_instead_of_broadcast(spark, tmp_path, tiny_splits, monkeypatch):
    monkeypatch.setattr(json_array, "MOST_BROADCAST", 1)
    (tmp_path / "a.json").write_text(json.dumps(HARD))
    tiny_splits(11)
    assert len(texts(spark, tmp_path)) == len(HARD)


def test_written_arrays_are_read_back(spark, tmp_path):
    rows = spark.range(500).select("id", F.to_json(F.struct("id")).alias("line"))
    json_array.write_array_files(rows, "line", "id", str(tmp_path / "out"), 3)
    files = [p.read_text() for p in (tmp_path / "out").rglob("*.txt")]
    assert 0 < len(files) <= 3
    assert sorted(x["id"] for f in files for x in json.loads(f)) == list(range(500))
    assert sorted(json.loads(t)["id"] for t in texts(spark, tmp_path / "out")) == list(range(500))


def test_records_come_in_few_pieces(spark, tmp_path):
    record = {"event_id": "1", "order_id": "O-1", "payload": {"order_id": "O-1", "customer_id": "7"}}
    (tmp_path / "a.json").write_text(json.dumps([record] * 100))
    # a piece costs a row twice: one a member, not one a quote
    assert json_array._pieces(spark, str(tmp_path)).count() <= 400
    assert [json.loads(x) for x in texts(spark, tmp_path)] == [record] * 100


def test_many_batches_of_one_split(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    records = [*HARD, {"long": ["x" * 50, *range(40)]}] * 3
    (tmp_path / "a.json").write_text(json.dumps(records))
    try:
        for size in (1, 2, 5):
            spark.conf.set(name, size)
            assert [json.loads(x) for x in texts(spark, tmp_path)] == records
    finally:
        spark.conf.set(name, before)
