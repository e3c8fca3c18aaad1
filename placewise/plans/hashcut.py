"""The n rows with the smallest seeded hash, per group, without ranking or gathering the group.

Rows are chosen by comparing them with a cut-off hash. To find it, the hash is cut into slices by its first
hex digits, rows per slice are counted, and only the slice in which the n-th row falls is ranked: one row in
a million, whatever the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

PREFIX = 5  # hex digits: 1,048,576 slices


def with_cut(df: DataFrame, group: str | None, key: str, quotas: Callable[[DataFrame], DataFrame], seed: int,
             out: str) -> DataFrame:
    """Adds ``out``: true for the ``quota`` rows of each group whose hash of the unique ``key`` is smallest.

    Without ``group`` all rows are one. ``quotas`` turns (group, rows) into (group, quota). The same rows are chosen on any partitioning. A null key, or
    a repeated one that the cut would have to part, fails the job: the choice would not be exact.
    """
    parts = [group] if group else []
    digest = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.select(*parts, digest.alias("digest"), F.col(key).alias("id")).withColumn(
        "slice", F.substring("digest", 1, PREFIX))
    slices = hashed.groupBy(*parts, "slice").agg(F.count("*").alias("rows"))
    totals = slices.groupBy(*parts).agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("slice").isNull(), F.col("rows"))).alias("unkeyed"))
    totals = totals.where(F.when(F.col("unkeyed") > 0, F.raise_error(F.lit(f"null in key column {key}")).cast("boolean"))
                          .otherwise(F.lit(True)))
    wanted = quotas(totals.select(*parts, "rows")).select(*parts, "quota")
    within = Window.partitionBy(*parts or [F.lit(1)])
    ordered = within.orderBy("slice")
    edge = (
        (slices.join(wanted, group) if group else slices.withColumn("quota", wanted.scalar()))
        .withColumn("need", F.col("quota") - F.sum("rows").over(ordered) + F.col("rows"))
        .where((F.col("need") > 0) & (F.col("need") <= F.col("rows"))).select(*parts, "slice", "need")
    )
    ranking = within.orderBy("digest", "id")
    parted = F.col("id").eqNullSafe(F.col("next")) & F.col("next").isNotNull()
    cut = (
        hashed.join(edge, [*parts, "slice"]).withColumns(
            {"rank": F.row_number().over(ranking), "next": F.lead("id").over(ranking)})
        .where(F.col("rank") == F.col("need"))
        .select(*parts, F.when(parted, F.raise_error(F.lit(f"repeated value in key column {key}")))
                .otherwise(F.col("digest")).alias("_digest"), F.col("id").alias("_id"))
    )
    here, last = F.struct(digest.alias("digest"), F.col(key).alias("id")), F.struct("_digest", "_id")
    below = F.col("_digest").isNotNull() & (here <= last)
    if group:
        return df.join(cut, group, "left").withColumn(out, below).select(*df.columns, out)
    one = cut.agg(F.first(F.struct("_digest", "_id"))).scalar()
    return df.withColumn("_cut", one).select("*", "_cut.*").withColumn(out, below).select(*df.columns, out)
