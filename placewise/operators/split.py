"""Seeded stratified split with exact class quotas.

What a class needs (a cut-off, a weight) is a table with a row per class, joined back: Spark broadcasts it if it is
small, else it splits the partitions of a hot class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from placewise.plans.hashcut import with_cut


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))


def class_quotas(counts: DataFrame, label: str, test: float) -> DataFrame:
    """Test rows per class, from (label, rows): ceil(test * n) in all, shared out by largest remainder."""
    every = Window.partitionBy(F.lit(1))  # one row per class
    shared = counts.withColumn("n", F.sum("rows").over(every)).withColumn(
        "size", F.ceil(F.col("n") * F.lit(test)))
    # integer arithmetic, so that equal remainders compare as equal
    shared = (
        shared.withColumn("base", F.expr("cast((cast(rows as decimal(38,0)) * size) div n as bigint)"))
        .withColumn("remainder", F.expr("cast(rows as decimal(38,0)) * size - cast(base as decimal(38,0)) * n"))
        .withColumn("spare", F.col("size") - F.sum("base").over(every))
        .withColumn("place", F.row_number().over(every.orderBy(F.col("remainder").desc(), label)))
    )
    return shared.select(
        label, "rows", (F.col("base") + (F.col("place") <= F.col("spare")).cast("bigint")).alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42,
                     out: str = "part") -> DataFrame:
    """Adds ``out`` = ``test`` or ``train``; each class gives its quota of rows with the smallest seeded hash.

    Rows without a label are left out. A null ``key``, or a repeated one that the cut would part, fails the job. No
    class is gathered or ranked: each row is compared with the cut-off hash of its class.
    """
    rows = df.where(F.col(label).isNotNull())
    marked = with_cut(rows, label, key, lambda counts: class_quotas(counts, label, test), seed, "_test")
    return marked.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds ``n / (classes * rows of the class)``; rows without a label are left out."""
    every = Window.partitionBy(F.lit(1))  # one row per class
    weights = class_counts(df, label).select(
        label, (F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows"))).alias(out))
    return df.join(weights, label).select(*df.columns, out)
