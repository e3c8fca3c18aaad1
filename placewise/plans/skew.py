"""Salted left join for a fact table whose keys are skewed and a dimension too large to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, partitions: int, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows, and into how many groups each is to be cut.

    There are fewer than ``1 / share`` of them, whatever the data. A key gets as many groups as its share of
    the shuffle partitions, so a group is about as large as a partition.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    counts = counts.where(F.col(key).isNotNull()).withColumn("_total", total)
    groups = F.ceil(F.col("_n") * partitions / F.col("_total")).cast("int") + 1
    return counts.where(F.col("_n") > F.col("_total") * F.lit(share)).select(key, groups.alias("_groups"))


def salted_left_join(fact: DataFrame, dim: DataFrame, key: str, spread: list[str],
                     share: float = HOT_SHARE) -> DataFrame:
    """``fact LEFT JOIN dim USING (key)`` with the rows of hot keys and of the null key spread out.

    The salt is a hash of the ``spread`` columns (a row id is best), so a recomputed task makes the same rows. Only the
    dimension rows of hot keys are copied. The table of hot keys is bounded, hence the broadcast.
    """
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(fact, key, partitions, share))
    groups = F.when(F.col(key).isNull(), F.lit(partitions)).otherwise(F.coalesce(F.col("_groups"), F.lit(1)))
    left = fact.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), groups.cast("bigint")).cast("int")).drop("_groups")
    right = dim.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn("_salt", F.explode(
        F.sequence(F.lit(0), F.coalesce(F.col("_groups"), F.lit(1)) - 1))).drop("_groups")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
