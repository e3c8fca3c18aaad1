import os
import uuid

import pytest
from pyspark.sql import functions as F

from placewise.operators.keyed import insert_new, upsert
from placewise.sources import buckets as B
from tests.test_plans import plan

N = 32
KEYS = ["k"]


@pytest.fixture
def store(spark, tmp_path):
    class Store:
        name, path = f"store_{uuid.uuid4().hex}", str(tmp_path / "store")
        rows = spark.range(2000).selectExpr("id k", "id * 2 v", "'old' w")

        def create(self):
            return B.create_buckets(self.rows, self.name, self.path, KEYS, N)

        def read(self):
            return B.read_buckets(spark, self.name)

        def upsert(self, batch):
            return B.upsert_buckets(spark, self.name, self.path, batch, KEYS, N, ["v"], ["v"])

    s = Store()
    yield s
    spark.sql(f"drop table if exists {s.name}")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_ten_keys_rewrite_at_most_ten_buckets(spark, store, as_rows):
    target = store.create()
    assert as_rows(target) == as_rows(store.rows)
    before, was = files(store.path), B._locations(spark, store.name)
    batch = spark.createDataFrame([(i * 301, -i, "new") for i in range(10)], "k long, v long, w string")
    want = as_rows(upsert(store.rows, batch, KEYS, ["v"], ["v"]))
    touched = store.upsert(batch)
    assert as_rows(store.read()) == want
    now = B._locations(spark, store.name)
    assert 0 < len(touched) <= 10 and {b for b in now if now[b] != was.get(b)} == set(touched)
    assert before <= files(store.path) and len(files(store.path) - before) == len(touched)
    store.upsert(batch)  # the same batch again changes nothing
    assert as_rows(store.read()) == want


def above_first_scan(text):
    """The plan's lines from its root down to the first scan, without side branches."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    path, level = [], 10**9
    for line in reversed(text[:text.index("FileScan") + 1].splitlines()):
        if depth(line) < level:
            path.append(line)
            level = depth(line)
    return path


def test_the_target_is_read_in_place(spark, store, tmp_path):
    store.create()
    batch = spark.createDataFrame([(1, 2, "x"), (5000, 3, "y")], "k long, v long, w string")
    text = plan(upsert(B.touched_rows(spark, store.name, [1, 2]), batch, KEYS, ["v"], ["v"]))
    assert "FullOuter" in text and not any("Exchange" in line for line in above_first_scan(text)), text
    assert "Bucketed: true" in text and "PartitionFilters: [_bucket" in text
    store.rows.write.parquet(str(tmp_path / "plain"))
    text = plan(upsert(spark.read.parquet(str(tmp_path / "plain")), batch, KEYS, ["v"], ["v"]))
    assert any("Exchange" in line for line in above_first_scan(text))


def test_superseded_folders_go(spark, store, as_rows):
    store.create()
    touched = store.upsert(spark.createDataFrame([(1, -1, "x"), (2, -2, "y")], "k long, v long, w string"))
    want = as_rows(store.read())
    assert B.drop_superseded(spark, store.name, store.path) == len(touched)
    assert as_rows(store.read()) == want and B.drop_superseded(spark, store.name, store.path) == 0


def test_new_buckets_nulls_and_empty_batches(spark, store, as_rows):
    store.rows = store.rows.limit(0)
    store.create()
    empty = spark.createDataFrame([], "k long, v long, w string")
    assert store.upsert(empty) == [] and as_rows(store.read()) == []
    batch = spark.createDataFrame([(i % 50, i, "n") for i in range(100)], "k int, v long, w string")  # another key type
    store.upsert(batch)
    assert as_rows(store.read()) == [(i, i + 50, "n") for i in sorted(range(50), key=str)]
    more = spark.createDataFrame([(1, 0, "z"), (900, 1, "z"), (900, 2, "z"), (None, 5, "z")], "k long, v long, w string")
    want = as_rows(insert_new(store.read(), more, KEYS, ["v"]))
    B.insert_buckets(spark, store.name, store.path, more, KEYS, N, ["v"])
    assert as_rows(store.read()) == want and (900, 1, "z") in want
    with pytest.raises(Exception, match="null in key columns"):
        store.upsert(more)
    assert as_rows(store.read()) == want


def test_a_crash_between_two_buckets_is_put_right(spark, store, as_rows, monkeypatch):
    store.create()
    batch = spark.range(200).selectExpr("id * 10 k", "-id v", "'new' w")
    want = as_rows(upsert(store.rows, batch, KEYS, ["v"], ["v"]))
    whole = B._locations
    monkeypatch.setattr(B, "_locations", lambda spark, name: dict(list(whole(spark, name).items())[:5]))
    store.upsert(batch)  # as if it had ended after five buckets
    assert store.read().where(F.col("v") < 0).count() not in (0, 199)
    monkeypatch.undo()
    store.upsert(batch)
    assert as_rows(store.read()) == want
