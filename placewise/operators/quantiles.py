"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of its group in one place. Here rows are counted in order-preserving buckets
where they lie, and only the rows of buckets that hold a wanted rank are moved and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.plans.ranges import CUTS_PER_BUCKET, bucket_tree, splitters, with_bucket


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One row per column: ``column_name``, ``n`` and ``quantiles``, linear between the two nearest ranks.

    Nulls and NaN are left out; a column without any value has no row.
    """
    return numeric_summary(df, cols, probs).where("n > 0").select("column_name", "n", "quantiles")


def numeric_summary(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """``column_name``, ``n``, ``mean``, ``std``, ``low``, ``high`` and ``quantiles`` of each column, null if empty."""
    x = {c: _number(c) for c in cols}
    moments = df.agg(*[F.struct(
        F.lit(c).alias("column_name"), F.count(x[c]).alias("n"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"),
        F.min(x[c]).alias("low"), F.max(x[c]).alias("high")).alias(c) for c in cols])
    known = moments.select(F.inline(F.array(*cols)))
    base, levels = bucket_tree(df.sparkSession)
    buckets = base ** levels

    # cut points from a bounded draw: they only decide how much has to be looked at again
    total = moments.agg(F.max(F.greatest(*[F.col(f"{c}.n") for c in cols])) if len(cols) > 1
                        else F.max(f"{cols[0]}.n")).scalar()
    draw = F.rand(1) < F.lit(float(CUTS_PER_BUCKET * buckets)) / F.nullif(total, F.lit(0).cast("bigint"))
    cuts = df.where(draw).agg(F.struct(*[splitters(x[c], buckets).alias(c) for c in cols])).scalar()
    long = df.withColumn("_all", cuts).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), x[c].alias("value"), F.col("_all")[c].alias("_cuts")) for c in cols])))
    numbered = with_bucket(long.where("value is not null"), "value", "_cuts", base, levels, "bucket").drop("_cuts")

    # rows per bucket, counted before the shuffle: the column itself stays where it is
    until = F.sum("rows").over(Window.partitionBy("column_name").orderBy("bucket"))
    sizes = numbered.groupBy("column_name", "bucket").agg(F.count("*").alias("rows")).withColumn("before", until - F.col("rows"))
    sizes = sizes.withColumn("total", F.sum("rows").over(Window.partitionBy("column_name")))
    low = [F.floor(F.lit(p) * (F.col("total") - 1)) for p in probs]
    high = [F.ceil(F.lit(p) * (F.col("total") - 1)) for p in probs]
    first, last = F.col("before"), F.col("before") + F.col("rows") - 1
    wanted = F.exists(F.array(*low, *high), lambda rank: rank.between(first, last))
    # two ranks per probability and column, so no more rows than that
    targets = sizes.where(wanted).select("column_name", "bucket", "before", "total")

    # only rows of the buckets that hold a wanted rank move; equal values move as one row
    counts = numbered.join(F.broadcast(targets), ["column_name", "bucket"]).groupBy(
        "column_name", "bucket", "before", "total", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("until", F.col("before") + F.sum("n").over(
        Window.partitionBy("column_name", "bucket").orderBy("value")))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("until") - F.col("n")) & (rank < F.col("until")), F.col("value")))

    picked = ranked.groupBy("column_name").agg(
        F.max("total").alias("total"),
        *[at(rank).alias(f"low{i}") for i, rank in enumerate(low)],
        *[at(rank).alias(f"high{i}") for i, rank in enumerate(high)])
    values = [
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (F.lit(p) * (F.col("total") - 1) - low[i])
        for i, p in enumerate(probs)]
    return known.join(picked.select("column_name", F.array(*values).alias("quantiles")), "column_name", "left")


def _edges(df: DataFrame, col: str, q: int) -> Column:
    return exact_quantiles(df, [col], [i / q for i in range(q + 1)]).agg(F.first(F.array_distinct("quantiles"))).scalar()


def _bin_number(x: Column, q: int) -> Column:
    """Number of edges below x, at least 1; ``_edges`` has up to q + 1 of them."""
    below = F.lit(0)
    for i in range(q + 1):
        below = below + F.coalesce((F.get("_edges", F.lit(i)) < x).cast("int"), F.lit(0))
    return F.greatest(F.lit(1), below)


def _label() -> Column:
    opening = F.when(F.col("bin_no") == 1, F.lit("[")).otherwise(F.lit("("))
    lo, hi = (F.col(c).cast("string") for c in ("bin_lo", "bin_hi"))
    return F.concat(opening, lo, F.lit(", "), hi, F.lit("]"))


def _with_bins(rows: DataFrame, x: Column, q: int) -> DataFrame:
    number = F.when(x.isNotNull() & (F.size("_edges") > 1), _bin_number(x, q))
    return rows.withColumn("bin_no", number).withColumns({
        "bin_lo": F.get("_edges", F.col("bin_no") - 1), "bin_hi": F.get("_edges", F.col("bin_no"))}).drop("_edges")


def quantile_bins(df: DataFrame, col: str, q: int = 4) -> DataFrame:
    """Adds ``bin_no`` (from 1), ``bin_lo``, ``bin_hi`` and ``bin_label`` of ``q`` equal-count intervals.

    Equal edges are merged; intervals are closed on the right, the first one on both sides. Ties always
    share a bin. Null values, and all values of a constant column, get no bin.
    """
    rows = df.withColumn("_edges", _edges(df, col, q))
    return _with_bins(rows, _number(col), q).withColumn("bin_label", _label())


def mean_by_quantile(df: DataFrame, col: str, measure: str, q: int = 4, out: str | None = None) -> DataFrame:
    """Mean of ``measure`` per quantile bin of ``col``, over rows that have both."""
    rows = df.select(F.col(col).cast("double").alias("x"), F.col(measure).alias("m")).na.drop()
    binned = _with_bins(rows.withColumn("_edges", _edges(rows, "x", q)), F.col("x"), q)
    return (
        binned.groupBy("bin_no", "bin_lo", "bin_hi")
        .agg(F.count("*").alias("rows"), F.avg("m").alias(out or f"avg_{measure}"))
        .where(F.col("bin_no").isNotNull()).withColumn("bin_label", _label()).orderBy("bin_no")
    )


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: count, mean, sample standard deviation, min, exact quartiles, max."""
    parts = [F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(["p25", "p50", "p75"])]
    return numeric_summary(df, cols, [0.25, 0.5, 0.75]).select(
        "column_name", F.col("n").alias("count"), "mean", "std", F.col("low").alias("min"), *parts,
        F.col("high").alias("max")).orderBy("column_name")
