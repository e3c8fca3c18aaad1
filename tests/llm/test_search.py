import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import maxscore as M


def brute(rows, asks, k, scale=64):
    dims = max((len(v) for _, v in rows if v), default=0)
    cut = lambda x: min(max(x, -2**63), 2**63 - 1)
    usable = [(i, tuple(cut(math.floor(scale * x)) for x in v) + (0,) * (dims - len(v))) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if asks(q):
            found = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in usable if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def search(df, k=5):
    return sorted(tuple(r) for r in M.topk_search(df, F.col("vec_id") % 3 == 0, k=k).collect())


SCHEMA = "vec_id long, embedding array<float>"


def test_ties_nulls_and_repeats(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(30)] + [(30, None), (31, [1.0, None, 0.0]), (32, [float("nan"), 0.0, 0.0]),
            (33, [float("inf"), 0.0, 1.0]), (None, same), (3, same), (36, [1.0]), (39, []), (6, [-1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "v": F.lit("x"), "part": F.lit(2), "asks": F.lit(0)})
    assert search(df) == brute(rows, lambda i: i % 3 == 0, 5)


def test_repeated_rows_count_each(spark):
    rows = [(20, [0.5]), (1, [0.5]), (1, [0.5]), (2, [0.25]), (3, [0.501]), (3, [0.502])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in M.topk_search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, 20) and len(got) == 5
    hot = [(7, [1.0])] * 400 + [(3, [0.5])] * 3 + [(9, [2.0])]
    assert search(spark.createDataFrame(hot, SCHEMA)) == brute(hot, lambda i: i % 3 == 0, 5)


def test_huge_components(spark):
    big, top = 1e30, [1e18, -1e18]
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 3.0]), (3, [0.5, 0.5]), (4, [big, 9.0]), (6, top), (7, top), (8, [1e300, 0.0]),
            (9, [-1e300, -5.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4)
    assert got == brute(rows, lambda i: i % 3 == 0, 4)


@pytest.mark.parametrize("shard, block, queries", [(40, 7, 30), (1 << 19, 2048, 1 << 18)])
def test_many_shards_and_blocks(spark, monkeypatch, shard, block, queries):
    monkeypatch.setattr(M, "SHARD_CELLS", shard * 8)
    monkeypatch.setattr(M, "QUERY_CELLS", queries * 8)
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 8).round(2)]) for i in range(300)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20)
    assert got == brute(rows, lambda i: i % 3 == 0, 20)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0]), (1, [1.0])]
    assert search(spark.createDataFrame(rows, SCHEMA)) == [(0, 1, 1, 4096)]
    assert search(spark.createDataFrame([], SCHEMA)) == []


def test_every_dtype_is_exact():
    r = np.random.default_rng(2)
    for size, kind in ((50, np.float32), (1 << 20, np.float64), (1 << 27, object)):
        x = r.integers(-size, size, (200, 9))
        q = r.integers(-size, size, 9)
        assert M.exact_dtype(9, x, q) is kind
        shard = M.Shard(np.arange(200), x.astype(kind))
        ids, scores = shard.search(-1, q.astype(kind), 10)
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q, row)), i) for i, row in enumerate(x.tolist()))[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == want
