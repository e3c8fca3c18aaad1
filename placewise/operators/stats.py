"""Correlation, least squares, trend line, standardising."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.plans.ranges import CUTS_PER_BUCKET, bucket_tree, splitters, with_bucket


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every pair (x, y), over the rows that have both; one pass for all pairs."""
    def value(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None))

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    packed = df.agg(*[F.corr(value(a), value(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r"))
             for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return packed.select(F.inline(F.array(*cells))).orderBy("x", "y")


def ols_simple(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares ``y ~ x`` over complete pairs: slope, intercept, R squared, rows."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _ln_beta_half(a: Column) -> Column:
    """ln B(a, 1/2), by the ratio of gamma functions at a + 20 and the 20 factors down to a."""
    down = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(0.0),
                       lambda acc, i: acc + F.log((a + i) / (a + i + 0.5)))
    z = a + 20
    ratio = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z ** 3) - 1 / (640 * z ** 5) + F.lit(17.0) / (14336 * z ** 7)
    return F.lit(log(pi) / 2) - ratio - down


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of the named values, each evaluated once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def t_tail(square: Column, dof: Column) -> Column:
    """P(|T| > t) of Student's t as ``p`` and its natural logarithm ``log_p``, from t squared.

    The incomplete beta function I(v/2, 1/2) at v / (v + t^2) as a continued fraction, in as many terms as it takes to settle.
    The upper tail is computed as such, in logarithms, so that probabilities too small for a double keep their digits there.
    Both are null if t or the degrees of freedom are missing, or the latter not positive.
    """
    v = F.when(dof > 0, dof.cast("double"))

    def parts(k):
        x0 = k["v"] / (k["v"] + k["s"])
        tail = x0 < (k["v"] / 2 + 1) / (k["v"] / 2 + 2.5)  # else the fraction of the other end converges
        return _let({"v": k["v"], "s": k["s"], "tail": tail, "a": F.when(tail, k["v"] / 2).otherwise(0.5),
                     "b": F.when(tail, 0.5).otherwise(k["v"] / 2), "x": F.when(tail, x0).otherwise(k["s"] / (k["v"] + k["s"]))},
                    finish)

    def finish(k):
        front = (-k["v"] / 2 * F.log1p(k["s"] / k["v"]) + F.log(k["s"] / (k["v"] + k["s"])) / 2 - _ln_beta_half(k["v"] / 2))
        return _let({"tail": k["tail"], "a": k["a"], "h": _fraction(k), "front": front}, lambda f: _let(
            {"log_p": F.when(f["tail"], f["front"] + F.log(f["h"] / f["a"])).otherwise(F.log1p(-2 * F.exp(f["front"]) * f["h"]))},
            lambda r: F.struct(F.exp(r["log_p"]).alias("p"), r["log_p"].alias("log_p"))))

    none, sure = (F.struct(F.lit(p).cast("double").alias("p"), F.lit(q).cast("double").alias("log_p"))
                  for p, q in ((None, None), (1.0, 0.0)))
    found = _let({"v": v, "s": square.cast("double")}, parts)
    return F.when(square.isNull() | v.isNull(), none).when(square == 0, sure).otherwise(found)


def _fraction(k: Column) -> Column:
    """The continued fraction of I(a, b) at x by Lentz's rule, two terms a step, until a step changes nothing."""
    tiny = F.lit(1e-300)

    def whole(y: Column) -> Column:
        return F.when(F.abs(y) < tiny, tiny).otherwise(y)

    def step(acc: Column, m: Column) -> Column:
        a, b, x = k["a"], k["b"], k["x"]
        terms = {"even": m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                 "odd": -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))}
        moved = _let(terms, lambda t: _let(
            {"d": 1 / whole(1 + t["even"] * acc["d"]), "c": whole(1 + t["even"] / acc["c"]), "odd": t["odd"]}, lambda u: _let(
                {"d": 1 / whole(1 + u["odd"] * u["d"]), "c": whole(1 + u["odd"] / u["c"]), "by": u["c"] * u["d"]}, lambda w: F.struct(
                    w["d"].alias("d"), w["c"].alias("c"), (acc["h"] * w["by"] * w["c"] * w["d"]).alias("h"),
                    (F.abs(w["by"] * w["c"] * w["d"] - 1) < 1e-16).alias("done")))))
        return F.when(acc["done"], acc).otherwise(moved)

    first = 1 / whole(1 - (k["a"] + k["b"]) * k["x"] / (k["a"] + 1))
    start = _let({"f": first}, lambda f: F.struct(f["f"].alias("d"), F.lit(1.0).alias("c"), f["f"].alias("h"), F.lit(False).alias("done")))
    # at most so many: the terms needed grow with the root of the degrees of freedom
    terms = F.sequence(F.lit(1), (F.lit(100) + 4 * F.ceil(F.sqrt(k["a"] + k["b"]))).cast("int"))
    return F.aggregate(F.transform(terms, lambda m: m.cast("double")), start, step)["h"]


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > t) of Student's t; null if t or the degrees of freedom are missing, or the latter not positive."""
    return t_tail(t * t, dof)["p"]


def t_critical(dof: Column, level: float = 0.05) -> Column:
    """The t that |T| exceeds with probability ``level``, for any degrees of freedom: Newton steps on log p over log t.

    The logarithm of the tail is a concave function of log t, so that the steps settle from any start.
    """
    def step(u: Column, _: Column) -> Column:
        return _let({"u": u, "v": dof.cast("double"), "log_p": t_tail(F.exp(2 * u), dof)["log_p"]}, newton)

    def newton(k):
        density = -_ln_beta_half(k["v"] / 2) - F.log(k["v"]) / 2 - (k["v"] + 1) / 2 * F.log1p(F.exp(2 * k["u"]) / k["v"])
        return k["u"] + (k["log_p"] - log(level)) / F.exp(log(2) + k["u"] + density - k["log_p"])

    return F.when(dof > 0, F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(log(2)), step)))


def ols_summary(df: DataFrame, y: str, x: str, order: str) -> DataFrame:
    """One row with the usual summary of ``y ~ x``.

    Coefficients with standard errors, t, p, its logarithm and 95% intervals, R squared, F, log-likelihood, AIC, BIC,
    residual skew and kurtosis, Jarque-Bera and Durbin-Watson (residuals in the order of ``order``, a unique
    number or text). Three scans: sufficient sums, cut points, residuals. The residuals are never ordered in one
    task: neighbours are paired inside order-preserving buckets, and buckets are joined at their ends. What a table
    cannot tell (too few rows, a constant regressor, a perfect fit) is null; an empty table gives n = 0.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"),
                     F.col(order).alias("ord")).na.drop(subset=["y", "x"])
    line = rows.agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"))
    known = line.agg(F.first(F.struct(*line.columns))).scalar()
    residuals = rows.withColumn("_fit", known).withColumn(
        "e", F.col("y") - F.col("_fit.intercept") - F.col("_fit.slope") * F.col("x"))
    fit = _residual_sums(residuals).withColumn("_fit", known).select("*", "_fit.*")

    n = F.col("n")
    dof = F.when(n > 2, n - 2)
    # a perfect fit has no spread to measure by, a constant regressor no slope: null, not an error
    rss, syy, sxx = F.nullif("rss", F.lit(0.0)), F.nullif("syy", F.lit(0.0)), F.nullif("sxx", F.lit(0.0))
    dw = F.col("steps")
    sigma2 = F.col("rss") / dof
    se_slope, se_intercept = F.sqrt(sigma2 / sxx), F.sqrt(sigma2 * (1 / n + F.col("mean_x") ** 2 / sxx))
    loglik = -n / 2 * (F.log(F.lit(2 * pi)) + F.log(rss / n) + 1)
    m1 = F.col("e1") / n
    m2 = F.nullif(F.col("rss") / n - m1 ** 2, F.lit(0.0))
    m3 = F.col("e3") / n - 3 * m1 * F.col("rss") / n + 2 * m1 ** 3
    m4 = F.col("e4") / n - 4 * m1 * F.col("e3") / n + 6 * m1 ** 2 * F.col("rss") / n - 3 * m1 ** 4
    fit = fit.withColumns({"skew": m3 / m2 ** 1.5, "kurtosis": m4 / m2 ** 2})
    jb = n / 6 * (F.col("skew") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4)
    out = fit.withColumns({
        "dof": dof, "slope_se": se_slope, "intercept_se": se_intercept,
        "r2": 1 - F.col("rss") / syy, "adj_r2": 1 - (F.col("rss") / dof) / (syy / (n - 1)),
        "loglik": loglik, "aic": 4 - 2 * loglik, "bic": 2 * F.log(n) - 2 * loglik,
        "jarque_bera": jb, "jarque_bera_p": F.exp(-jb / 2), "durbin_watson": dw / rss,
    })
    out = out.withColumns({f"{c}_t": F.col(c) / F.nullif(f"{c}_se", F.lit(0.0)) for c in ("slope", "intercept")})
    # each is used more than once: a column of its own is evaluated once
    out = out.withColumns({"critical": t_critical(F.col("dof")),
                           **{f"{c}_tail": t_tail(F.col(f"{c}_t") ** 2, F.col("dof")) for c in ("slope", "intercept")}})
    for c in ("slope", "intercept"):
        half = F.col("critical") * F.col(f"{c}_se")
        out = out.withColumns({f"{c}_p": F.col(f"{c}_tail.p"), f"{c}_log_p": F.col(f"{c}_tail.log_p"),
                               f"{c}_lo": F.col(c) - half, f"{c}_hi": F.col(c) + half})
    out = out.withColumns({"f_stat": F.col("slope_t") ** 2, "f_p": F.col("slope_p"), "f_log_p": F.col("slope_log_p")})
    names = ["n", "dof"]
    for c in ("intercept", "slope"):
        names += [c, *[f"{c}_{s}" for s in ("se", "t", "p", "log_p", "lo", "hi")]]
    return out.select(*names, "r2", "adj_r2", "f_stat", "f_p", "f_log_p", "loglik", "aic", "bic", "skew", "kurtosis",
                      "jarque_bera", "jarque_bera_p", "durbin_watson")


def _residual_sums(residuals: DataFrame) -> DataFrame:
    """One row: sums of the powers of the residuals ``e``, and of (e - previous e) squared in the order of ``ord``.

    Neighbours are paired inside buckets of ``ord``, and buckets are joined at their ends.
    """
    spark = residuals.sparkSession
    base, levels = bucket_tree(spark)
    # bounded by the number of buckets: the cut points only make buckets even, every row is bucketed
    share = F.lit(float(CUTS_PER_BUCKET * base ** levels)) / F.col("_fit.n")
    drawn = residuals.where((F.rand(1) < share) & F.col("ord").isNotNull())
    cuts = drawn.agg(splitters(F.col("ord"), base ** levels)).scalar()
    buckets = with_bucket(residuals.drop("_fit").withColumn("_cuts", cuts), "ord", "_cuts", base, levels, "bucket").drop("_cuts")
    inside = Window.partitionBy("bucket").orderBy("ord")
    steps = buckets.withColumn("step", F.col("e") - F.lag("e").over(inside))
    powers = [F.sum(F.pow("e", F.lit(float(p)))).alias(f"e{p}") for p in (1, 2, 3, 4)]
    per_bucket = steps.groupBy("bucket").agg(
        F.sum(F.col("step") * F.col("step")).alias("inner"), *powers,
        F.min(F.struct("ord", "e"))["e"].alias("first"), F.max(F.struct("ord", "e"))["e"].alias("last"))
    # one row per bucket
    gap = F.col("first") - F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("bucket"))
    return per_bucket.withColumn("gap", gap).agg(
        F.sum("e1").alias("e1"), F.sum("e2").alias("rss"), F.sum("e3").alias("e3"), F.sum("e4").alias("e4"),
        (F.coalesce(F.sum("inner"), F.lit(0.0)) + F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0))).alias("steps"))


def trend_line(df: DataFrame, y: str, x: str, points: int = 100) -> DataFrame:
    """``points`` evenly spaced x from min to max and the fitted ``a + b ln x`` at each; rows with x > 0."""
    rows = df.na.drop(subset=[x, y]).where(F.col(x) > 0)
    log_x = F.log(F.col(x).cast("double"))
    fit = rows.agg(
        F.regr_slope(F.col(y), log_x).alias("slope"), F.regr_intercept(F.col(y), log_x).alias("intercept"),
        F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    steps = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(points - 1)
    return steps.withColumn("x", at).select(
        "i", "x", (F.col("intercept") + F.col("slope") * F.log("x")).alias("y"))


def standardize(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """Adds ``(x - mean) / population std`` per column; a constant column is only centred."""
    moments = df.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                                F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in cols])
    fitted = moments.agg(F.first(F.struct(*cols))).scalar()
    fit = F.col("_fit")
    return df.withColumn("_fit", fitted).withColumns({
        f"{c}{suffix}": (F.col(c).cast("double") - fit[c]["mean"])
        / F.coalesce(F.nullif(fit[c]["std"], F.lit(0.0)), F.lit(1.0)) for c in cols}).drop("_fit")
