"""Ordered windows over one hot partition, cut into blocks.

A window runs each partition in one task. Positions here are integers, so a partition is cut into blocks
of ``block`` positions that run in parallel: a running total adds the sum of the earlier blocks, and a
frame of the last k rows gets k rows of the block before it (its halo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536


def block_of(pos: str, block: int = BLOCK) -> Column:
    return F.expr(f"`{pos}` div {block}")


def running_total(df: DataFrame, part: list[str], pos: str, value: str, out: str, block: int = BLOCK,
                  terms: DataFrame | None = None) -> DataFrame:
    """``sum(value)`` over all rows of the partition up to this position (one row per position).

    ``terms`` may hold the same sums in a form that is cheaper to compute twice; it needs a row in each block.
    """
    cut = df.withColumn("_block", block_of(pos, block))
    terms = cut if terms is None else terms.withColumn("_block", block_of(pos, block))
    before = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        terms.groupBy(*part, "_block").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    within = Window.partitionBy(*part, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*part, "_block"])
        .withColumn(out, F.col("_offset") + F.sum(value).over(within))
        .drop("_block", "_offset")
    )


def with_halo(df: DataFrame, pos: str, before: int, block: int = BLOCK) -> DataFrame:
    """Adds ``_block`` and ``_halo``; the last ``before`` positions of a block also appear in the next one."""
    if before >= block:
        raise ValueError("the halo must be smaller than a block")
    home = block_of(pos, block)
    tail = F.pmod(F.col(pos), F.lit(block)) >= block - before
    copies = F.when(
        tail, F.array(F.struct(home.alias("_block"), F.lit(False).alias("_halo")),
                      F.struct((home + 1).alias("_block"), F.lit(True).alias("_halo"))),
    ).otherwise(F.array(F.struct(home.alias("_block"), F.lit(False).alias("_halo"))))
    return df.select("*", F.inline(copies))


def positions(df: DataFrame, part: list[str], last: str, out: str, block: int = BLOCK) -> DataFrame:
    """One row for each position 1..``last`` of each partition, in arrays no longer than ``block``."""
    starts = df.select(*part, last, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(last).cast("bigint"),
                                                         F.lit(block).cast("bigint"))).alias("_start"))
    ends = F.least(F.col("_start") + F.lit(block - 1), F.col(last).cast("bigint"))
    # a long partition's blocks are spread out before each becomes its many rows
    return starts.repartition(*part, "_start").select(*part, F.explode(F.sequence(F.col("_start"), ends)).alias(out))
