import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators import stats as S


def t_tail(t, dof, steps=400_000):
    """P(|T| > t) by integrating the density over t / sin(s), from the tail inwards, in logarithms."""
    c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - math.log(dof * math.pi) / 2
    # u = t * exp(v): steps as long as the density's own scale
    v = np.linspace(0, max(50 / dof, 60 / (1 + t * t * (dof + 1) / (dof + t * t))), steps)
    u = t * np.exp(v)
    log_density = c - (dof + 1) / 2 * np.log1p(u * u / dof) + np.log(u)
    y = np.exp(log_density)
    return 2 * float(np.sum((y[:-2:2] + 4 * y[1:-1:2] + y[2::2])[:steps // 2]) * (v[1] - v[0]) / 3)


def test_t_distribution(table):
    dofs = [1, 2, 3, 10, 31, 100, 775, 5000, 1_000_000]
    points = [(t, dof) for dof in dofs for t in (0.3, 1.5, 2.6, 10.0, 14.8, 37.0)]
    got = table("t double, dof bigint", *points).select("t", "dof", S.t_two_sided(-F.col("t"), F.col("dof")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(t_tail(r["t"], r["dof"]), rel=1e-8)


def test_t_critical(spark, table):
    """The same as bisection, to 1e-10, from one degree of freedom to a million."""
    dofs = [1, 2, 3, 4, 7, 9, 10, 31, 100, 775, 14_998, 1_000_000]
    df = table("dof bigint", *[(d,) for d in dofs]).withColumns({"lo": F.lit(1.0), "hi": F.lit(20.0)})
    for _ in range(5):  # 19 / 2 ** 40 is left
        for _ in range(8):
            middle = (F.col("lo") + F.col("hi")) / 2
            df = df.withColumn("above", S.t_two_sided(middle, F.col("dof")) > 0.05)
            df = df.withColumns({"lo": F.when(F.col("above"), middle).otherwise(F.col("lo")),
                                 "hi": F.when(F.col("above"), F.col("hi")).otherwise(middle)})
        df = spark.createDataFrame(df.collect(), df.schema)
    found = df.withColumn("t", S.t_critical(F.col("dof"))).collect()
    for r in found:
        assert r["t"] == pytest.approx((r["lo"] + r["hi"]) / 2, abs=1e-10)
    t = {r["dof"]: r["t"] for r in found}
    assert t[1] == pytest.approx(math.tan(math.pi * 0.475), rel=1e-12) and t[2] == pytest.approx(
        0.95 * math.sqrt(2 / (1 - 0.95 ** 2)), rel=1e-12)
    assert table("dof bigint", (0,), (None,)).select(S.t_critical(F.col("dof")).alias("t")).where("t is not null").count() == 0


def test_logarithms_of_tiny_probabilities(table):
    got = table("t double, dof bigint", (106.47, 14_998), (1e6, 3)).select(S.t_tail(F.col("t") ** 2, F.col("dof")).alias("p"))
    p = [r.p for r in got.collect()]
    assert p[0].p == 0 and p[0].log_p == pytest.approx(-4226.0899, abs=1e-3)
    assert p[1].log_p == pytest.approx(math.log(t_tail(1e6, 3)), rel=1e-9)


def test_t_distribution_at_the_ends(table):
    df = table("t double, dof bigint", (0.0, 5), (None, 5), (1.0, 0), (1.0, None), (1.0, 1))
    got = [r[0] for r in df.select(S.t_two_sided(F.col("t"), F.col("dof"))).collect()]
    assert got == [1.0, None, None, None, pytest.approx(0.5, rel=1e-12)]  # the last one is Cauchy's


@pytest.mark.parametrize("pairs", [[], [(1, 1.0, 2.0)], [(1, 1.0, 2.0), (2, 2.0, 3.0)], [(i, 5.0, float(i)) for i in range(9)],
                                   [(i, float(i), 2.0 * i) for i in range(9)], [(1, None, 2.0)]])
def test_ols_summary_of_poor_tables(table, pairs):
    r = S.ols_summary(table("i bigint, x double, y double", *pairs), "y", "x", "i").first()
    assert r["slope_p"] is None and r["f_p"] is None and r["slope_t"] is None


@pytest.mark.parametrize("order", ["i", "text"])
def test_ols_summary(table, order):
    rng = random.Random(6)
    x = [rng.uniform(0, 10) for _ in range(400)]
    y = [2 + 0.7 * v + rng.gauss(0, 1) for v in x]
    df = table("i bigint, x double, y double", *zip(range(400), x, y)).withColumn(
        "text", F.lpad(F.col("i").cast("string"), 6, "0"))
    r = S.ols_summary(df.union(df.limit(1).withColumn("y", F.lit(None))), "y", "x", order).first()
    X = np.column_stack([np.ones(400), x])
    beta, *_ = np.linalg.lstsq(X, np.array(y), rcond=None)
    e = np.array(y) - X @ beta
    rss, n = float(e @ e), 400
    cov = rss / (n - 2) * np.linalg.inv(X.T @ X)
    assert (r["intercept"], r["slope"]) == pytest.approx(tuple(beta))
    assert (r["intercept_se"], r["slope_se"]) == pytest.approx(tuple(np.sqrt(np.diag(cov))))
    assert r["durbin_watson"] == pytest.approx(float(np.sum(np.diff(e) ** 2)) / rss)
    assert r["n"] == 400 and r["dof"] == 398
    r2 = 1 - rss / float(np.sum((np.array(y) - np.mean(y)) ** 2))
    assert r["r2"] == pytest.approx(r2) and r["adj_r2"] == pytest.approx(1 - (1 - r2) * 399 / 398)
    loglik = -n / 2 * (math.log(2 * math.pi * rss / n) + 1)
    assert r["aic"] == pytest.approx(4 - 2 * loglik) and r["bic"] == pytest.approx(2 * math.log(n) - 2 * loglik)
    m = [float(np.mean(e ** k)) for k in (2, 3, 4)]
    skew, kurt = m[1] / m[0] ** 1.5, m[2] / m[0] ** 2
    assert (r["skew"], r["kurtosis"]) == pytest.approx((skew, kurt))
    jb = n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4)
    assert (r["jarque_bera"], r["jarque_bera_p"]) == pytest.approx((jb, math.exp(-jb / 2)))
    assert r["slope_lo"] < 0.7 < r["slope_hi"] and r["slope_p"] < 1e-9
    assert r["f_stat"] == pytest.approx(r["slope_t"] ** 2)


def test_corr_skips_incomplete_pairs(table):
    df = table("a double, b double, c double", (1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, float("nan"), 5.0), (4.0, 8.5, 2.0))
    got = {(r["x"], r["y"]): r["r"] for r in S.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 8.5])[0, 1])
    assert got["a", "c"] == pytest.approx(np.corrcoef([2, 3, 4], [1, 5, 2])[0, 1])


def test_trend_line(table):
    df = table("x bigint, y double", *[(x, 1 + 0.5 * math.log(x)) for x in (1, 3, 10, 50)], (0, 9.0), (None, 1.0))
    got = S.trend_line(df, "y", "x", 5).orderBy("i").collect()
    assert [r["x"] for r in got] == pytest.approx([1, 13.25, 25.5, 37.75, 50])
    assert [r["y"] for r in got] == pytest.approx([1 + 0.5 * math.log(r["x"]) for r in got])


def test_standardize(table):
    df = table("x int, c int", (1, 5), (2, 5), (6, 5))
    got = [(r["x_scaled"], r["c_scaled"]) for r in S.standardize(df, ["x", "c"]).orderBy("x").collect()]
    v = np.array([1, 2, 6])
    assert [g[0] for g in got] == pytest.approx(list((v - v.mean()) / v.std()))
    assert [g[1] for g in got] == [0, 0, 0]
