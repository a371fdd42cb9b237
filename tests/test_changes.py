"""Tables merged on read: what is written follows the change, writers that meet are told, compaction changes no row."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.changes import ChangeTable, ConcurrentWrite


def rows(df):
    return sorted(map(tuple, df.select("k", "v").collect()), key=str)


def data(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v long")


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


@pytest.fixture
def table(spark, tmp_path):
    return ChangeTable(spark, str(tmp_path / "t"), ["k"], 4)


def test_latest_change_of_a_key_counts(spark, table):
    assert table.read() is None
    table.save(data(spark, ("a", 1), ("b", 2), (None, 3)))
    table.save(data(spark, ("b", 20), ("c", 30)), removed=data(spark, ("a", 0)))
    assert rows(table.read()) == rows(data(spark, ("b", 20), ("c", 30), (None, 3)))
    assert rows(table.read(1)) == rows(data(spark, ("a", 1), ("b", 2), (None, 3)))
    assert table.compact() and not table.compact()
    assert table.changes_since_base() == 0 and rows(table.read()) == rows(data(spark, ("b", 20), ("c", 30), (None, 3)))
    table.save(data(spark, ("a", 5), (None, 6)), removed=data(spark, ("c", 0)))
    assert rows(table.read()) == rows(data(spark, ("a", 5), ("b", 20), (None, 6)))


def test_bytes_follow_the_change(spark, table):
    table.save(spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.xxhash64("id").alias("v")))
    first = written(table.path)
    table.save(data(spark, ("7", 1), ("8", 1)))
    assert written(table.path) - first < first / 50
    assert table.read().count() == 50_000 and rows(table.read().where("k IN ('7', '8')")) == [("7", 1), ("8", 1)]


def test_two_writers_on_one_version(spark, tmp_path):
    one, two = (ChangeTable(spark, str(tmp_path / "t"), ["k"], 4) for _ in range(2))
    one.save(data(spark, ("a", 1)))
    seen = one.version(), two.version()
    one.save(data(spark, ("a", 2)), read_version=seen[0])
    with pytest.raises(ConcurrentWrite):
        two.save(data(spark, ("a", 3)), read_version=seen[1])
    assert rows(one.read()) == [("a", 2)]


def test_a_commit_that_comes_between_wins(spark, tmp_path, monkeypatch):
    """The other writer commits after this one has looked and before it commits itself."""
    one, two = (ChangeTable(spark, str(tmp_path / "t"), ["k"], 4) for _ in range(2))
    one.save(data(spark, ("a", 1)))
    commit = one._commit

    def late(c):
        two.save(data(spark, ("a", 9)))
        commit(c)

    monkeypatch.setattr(one, "_commit", late)
    with pytest.raises(ConcurrentWrite):
        one.save(data(spark, ("a", 2)))
    assert rows(two.read()) == [("a", 9)] and two.version() == 2


def test_repeated_batches_and_reading_some_keys(spark, table):
    assert table.save(data(spark, ("a", 1)), batch_id=0, writer="w")
    assert not table.save(data(spark, ("a", 2)), batch_id=0, writer="w")
    assert table.save(data(spark, ("b", 2)), batch_id=0, writer="x") and table.done("w") == 0 and table.done("y") == -1
    table.compact()
    assert not table.save(data(spark, ("a", 3)), batch_id=0, writer="w")
    assert rows(table.read(only=data(spark, ("b", 0), ("z", 0)).select("k"))) == [("b", 2)]


def test_replace_writes_differences_alone(spark, table):
    old = data(spark, ("a", 1), ("b", 2), ("c", None))
    table.save(old)
    before = written(table.path)
    table.replace(table.read(), data(spark, ("a", 1), ("b", 5), ("d", 4)), read_version=1)
    change = spark.read.parquet(f"{table.path}/{table.commit_of(2).folder}")
    assert sorted((r.k, r.v, r["__gone"]) for r in change.collect()) == [("b", 5, False), ("c", None, True), ("d", 4, False)]
    assert written(table.path) > before and rows(table.read()) == [("a", 1), ("b", 5), ("d", 4)]
