"""Sorts, top-k and fixed-size samples. Every order ends in a unique key, so cuts are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.plans.hashcut import with_cut


def _order(order: list) -> list[Column]:
    """``"col"`` or ``("col", 1)`` ascending, ``("col", -1)`` descending; nulls last either way."""
    pairs = [o if isinstance(o, tuple) else (o, 1) for o in order]
    return [F.col(c).desc_nulls_last() if sign < 0 else F.col(c).asc_nulls_last() for c, sign in pairs]


def sort_by(df: DataFrame, order: list) -> DataFrame:
    return df.orderBy(*_order(order))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*_order(order)).limit(k)


def preview(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return top_k(df, order, n)


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each group to k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*_order(order)))
    return df.where(F.col(group).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by a seeded hash of the unique ``key``.

    The same rows come out on any partitioning, and no task gathers the candidates of all others. Fails when
    the table has fewer rows, a null key, or a repeated key that would have to be parted.
    """
    chosen = with_cut(df, None, key, lambda counts: counts.withColumn("quota", F.lit(n).cast("bigint")), seed, "_chosen")
    chosen = chosen.where("_chosen").drop("_chosen")
    # a row-less branch that checks the size of the table, an empty one included
    too_few = F.raise_error(F.lit(f"fewer than {n} rows to sample")).cast("boolean")
    guard = df.agg(F.count("*").alias("_rows")).where(F.when(F.col("_rows") < n, too_few).otherwise(F.lit(False)))
    return chosen.unionByName(guard.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
