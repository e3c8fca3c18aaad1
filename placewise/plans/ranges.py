"""Order-preserving buckets of nearly equal size for a column of numbers or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CUTS_PER_BUCKET = 32  # rows drawn for each bucket to place its cut point


def bucket_tree(spark: SparkSession) -> tuple[int, int]:
    """(base, levels): at least as many buckets, base ** levels, as shuffle partitions, and at least 256."""
    partitions = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels = 2
    while 64 ** levels < partitions:
        levels += 1
    base = 16
    while base ** levels < partitions:
        base += 1
    return base, levels


def splitters(value: Column, buckets: int) -> Column:
    """Aggregate over a bounded sample: ``buckets - 1`` ascending cut points. They only affect how even buckets are."""
    ranked = F.sort_array(F.collect_list(value))
    at = F.sequence(F.lit(1), F.lit(buckets - 1))
    return F.when(F.size(ranked) > 0, F.transform(at, lambda i: F.get(
        ranked, F.floor(i * F.size(ranked) / F.lit(buckets)).cast("int"))))


def _count_below(value: str, cut, lo: int, hi: int) -> str:
    """SQL for how many of the ascending cuts ``lo .. hi - 1`` are below the value: a binary search."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    above, under = _count_below(value, cut, mid + 1, hi), _count_below(value, cut, lo, mid)
    return f"if({value} > {cut(mid)}, {above}, {under})"


def with_bucket(df: DataFrame, value: str, cuts: str, base: int, levels: int, out: str) -> DataFrame:
    """Adds how many of the ``base ** levels - 1`` cut points of the array column ``cuts`` lie below ``value``.

    A search tree: on each level ``base - 1`` cuts tell which part to look into. Some ten comparisons per row, all in
    generated code. A null value is in bucket 0.
    """
    df = df.withColumn(out, F.lit(0))
    for level in range(levels - 1, -1, -1):
        width = base ** level
        found = _count_below(value, lambda i, w=width: f"get({cuts}, {out} + {(i + 1) * w - 1})", 0, base - 1)
        df = df.withColumn(out, F.expr(f"{out} + {width} * {found}"))
    return df
