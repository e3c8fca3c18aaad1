import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from placewise.operators import aggregates as A, quantiles as Q, topk as TK
from placewise.plans.ranges import bucket_tree, with_bucket


def test_quantiles_against_numpy(table):
    rng = random.Random(1)
    cols = {"a": [rng.lognormvariate(0, 3) for _ in range(3000)], "b": [rng.choice([1, 2, 2, 2, 9]) for _ in range(3000)],
            "c": [rng.gauss(0, 1) if i % 3 else None for i in range(3000)], "d": [None] * 3000}
    df = table("a double, b int, c double, d double", *zip(*cols.values()))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {r["column_name"]: r for r in Q.exact_quantiles(df, list(cols), probs).collect()}
    assert "d" not in got
    for c in "abc":
        values = [v for v in cols[c] if v is not None]
        assert got[c]["n"] == len(values)
        assert list(got[c]["quantiles"]) == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


@pytest.mark.parametrize("base, levels", [(16, 2), (21, 2), (5, 3), (2, 4)])
@pytest.mark.parametrize("kind", ["double", "string"])
def test_buckets_count_the_cuts_below(table, base, levels, kind):
    r = random.Random(base)
    cuts = sorted(r.choice(range(4000)) / 2 for _ in range(base ** levels - 1))
    values = [-1.0, 0.0, 3.5, 777.0, 1200.5, 1999.5, 5000.0, *cuts[::7]]
    if kind == "string":
        cuts, values = sorted(f"key{c:09.1f}" for c in cuts), [f"key{v:09.1f}" for v in values]
    df = table(f"v {kind}", *[(v,) for v in values]).withColumn("cuts", F.lit(cuts).cast(f"array<{kind}>"))
    got = with_bucket(df, "v", "cuts", base, levels, "b").select("v", "b").collect()
    assert [row["b"] for row in got] == [sum(c < row["v"] for c in cuts) for row in got]


@pytest.mark.parametrize("partitions", [8, 200, 1000, 20_000, 300_000])
def test_buckets_follow_the_shuffle_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    base, levels = bucket_tree(spark)
    assert max(256, partitions) <= base ** levels < 4 * max(256, partitions) and base <= 64
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_of_a_hot_value(table):
    values = [5.0] * 4000 + [float(i) for i in range(2000)]
    row = Q.exact_quantiles(table("x double", *[(v,) for v in values]), ["x"], [0.1, 0.5, 0.9]).first()
    assert list(row["quantiles"]) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


@pytest.mark.parametrize("values", [
    [1, 1, 1, 1, 2, 3, 4, 4], [7] * 6, list(range(100)), [0, 0, 0, 0, 0, 5, 6], [1.5, 2.5], [3],
    [random.Random(2).choice(range(12)) for _ in range(200)],
])
def test_bins_against_pandas(table, values):
    df = table("i int, x double", *[(i, float(v)) for i, v in enumerate(values)], (999, None))
    got = {r["i"]: r["bin_no"] for r in Q.quantile_bins(df, "x").collect()}
    if len(set(values)) == 1:
        want = [None] * len(values)
    else:
        want = [c + 1 for c in pd.qcut(pd.Series(values, dtype=float), 4, duplicates="drop").cat.codes]
    assert [got[i] for i in range(len(values))] == want
    assert got[999] is None


def test_mean_by_quantile(table):
    df = table("x int, m double", (1, 1.0), (1, 3.0), (2, 5.0), (3, 7.0), (9, None))
    got = Q.mean_by_quantile(df, "x", "m", q=2).collect()
    assert [(r["bin_no"], r["bin_lo"], r["bin_hi"], r["rows"], r["avg_m"]) for r in got] == [
        (1, 1.0, 1.5, 2, 2.0), (2, 1.5, 3.0, 2, 6.0)]
    assert got[0]["bin_label"] == "[1.0, 1.5]" and got[1]["bin_label"] == "(1.5, 3.0]"


def test_describe_against_pandas(table):
    values = [random.Random(4).gauss(10, 3) for _ in range(501)]
    df = table("x double, e double", *[(v, None) for v in values], (None, None))
    x, = Q.describe_numeric(df, ["x", "e"]).where("column_name = 'x'").collect()
    want = pd.Series(values).describe()
    assert [x[c] for c in ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]] == pytest.approx(list(want))
    e, = Q.describe_numeric(df, ["x", "e"]).where("column_name = 'e'").collect()
    assert e["count"] == 0 and e["mean"] is None and e["p50"] is None


def test_area_summary_both_ways(table, as_rows):
    fact = table("zip string, rating double, price int", ("a", 4.0, 1), ("a", 4.5, None), ("b", None, 2), (None, 1.0, 1),
                 ("c", 3.0, 3))
    dim = table("zip string, pop int, inc int", ("a", 2000, 5), ("b", 0, None), ("c", 1000, 1), ("c", 1000, 2))
    args = ("zip", {"rating": "avg_rating", "price": "avg_price"}, ["pop", "inc"], "pop")
    joined = A.area_summary(fact.join(dim, "zip", "left"), *args)
    below = A.area_summary_of(fact, dim, *args)
    want = [("a", 2, 4.25, 1.0, 2000, 5, 1.0), ("b", 1, None, 2.0, 0, None, None), ("c", 2, 3.0, 3.0, 1000, 2, 2.0)]
    assert as_rows(joined) == as_rows(below) == want


def test_group_density_weights_aliases(table, as_rows):
    fact = table("city string", ("NY",), ("NYC",), ("NYC",), ("SF",), (None,), ("gone",))
    dim = table("city string, name string, pop int, inc int", ("NY", "New York", 1000, 3), ("NYC", "New York", 4000, 6),
                ("SF", "San Francisco", None, 1))
    want = [("New York", 3, 3000.0, 5.0, 1.0)]
    assert as_rows(A.group_density(fact.join(dim, "city", "left"), "name", "pop", ["inc"])) == want
    assert as_rows(A.group_density_of(fact, dim, "city", "name", "pop", ["inc"])) == want


def test_argmax_prefers_smallest_key(table):
    s = table("k int, m double, n int", (3, 5.0, 1), (1, 5.0, 0), (2, None, 1))
    assert tuple(A.argmax_by(s, "k", ["m", "n"]).first()) == (1, 2)


def test_empty_input(table):
    empty = table("place_id string, city string, rating double, user_ratings_total bigint, price_level int").limit(0)
    assert tuple(A.kpis(empty).first()) == (0, None, None, 0)
    assert A.segment_summary(empty, "city").count() == 0
    assert A.mean_by(empty, "city", "rating").count() == 0
    assert A.value_counts(empty, "city").count() == 0
    assert Q.mean_by_quantile(empty, "rating", "price_level").count() == 0
    assert Q.exact_quantiles(empty, ["rating"], [0.5]).count() == 0


def test_null_keys_leave_groups(table, as_rows):
    df = table("k string, v double", (None, 1.0), ("a", 2.0), ("a", None))
    assert as_rows(A.mean_by(df, "k", "v")) == [("a", 2.0)]
    assert as_rows(A.count_by(df, ["k"])) == [("a", 2)]
    assert as_rows(A.value_counts(df, "k", dropna=False)) == [("a", 2), (None, 1)]


def test_topk_ties_and_sample(table, as_rows):
    df = table("g string, k string, n int", ("x", "b", 2), ("x", "a", 2), ("x", "c", 9), ("y", "d", 1), (None, "e", 1))
    assert as_rows(TK.top_k_per_group(df, "g", [("n", -1), "k"], 2), "g", "k") == [("x", "a"), ("x", "c"), ("y", "d")]
    ids = table("id int", *[(i,) for i in range(100)])
    a = as_rows(TK.sample_n(ids, 30, "id", 7))
    assert a == as_rows(TK.sample_n(ids.repartition(8), 30, "id", 7)) and len(a) == 30
    assert a != as_rows(TK.sample_n(ids, 30, "id", 8))
    for frame in (ids, ids.limit(0)):
        with pytest.raises(Exception, match="fewer than 101 rows"):
            TK.sample_n(frame, 101, "id").collect()


def test_samples_are_exact_or_fail(table):
    holes = table("id int", *[(i if i % 5 else None,) for i in range(100)])
    with pytest.raises(Exception, match="null in key column id"):
        TK.sample_n(holes, 30, "id").collect()
    pairs = table("id int", *[(i // 2,) for i in range(100)])
    assert TK.sample_n(pairs, 30, "id").count() == 30
    with pytest.raises(Exception, match="repeated value in key column id"):
        TK.sample_n(pairs, 15, "id").collect()


def test_null_profile(table, as_rows):
    df = table("a int, b int, c int", (1, None, None), (None, None, 2))
    got = [tuple(r) for r in A.null_profile(df, 2).collect()]
    assert got == [("b", 2, 2, 3), ("a", 1, 2, 3)]
