"""Yield of a crawl: new keys per point, rolling mean, plateau, cap.

A crawl log has one row per result: region, point number (integers from 1), position, key. First sightings
are ``min`` aggregates, which combine on the map side; everything ordered runs in blocks of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from placewise.constants import (
    PLATEAU_MIN_NEW_AVG, PLATEAU_STABLE_POINTS, PLATEAU_WARMUP_POINTS, PLATEAU_WINDOW, TARGET_PER_CITY,
)
from placewise.plans.blocks import BLOCK, positions, running_total, with_halo


def _keyed(hits: DataFrame, key: str) -> DataFrame:
    text = F.col(key).cast("string")
    return hits.where(text.isNotNull() & (text != ""))


def yield_per_point(hits: DataFrame, region: str, point: str, key: str, existing: DataFrame | None = None,
                    last_point: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per point: ``got`` results, ``new_keys`` not seen at an earlier point or in the store, ``total`` seen.

    Points without results count as points: each region has all points from 1 to its last, which is the
    last with a result unless ``last_point`` (region, point) says that the crawl went further.
    """
    sightings = _keyed(hits, key).select(region, F.col(point).cast("bigint").alias("point_no"), key)
    if existing is not None:
        stored = _keyed(existing, key).select(region, F.lit(0).cast("bigint").alias("point_no"), key)
        sightings = sightings.unionByName(stored)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    firsts = sightings.groupBy(region, key).agg(F.min("point_no").alias("point_no")).select(
        region, "point_no", zero.alias("got"), one.alias("new_keys"))
    results = hits.select(region, F.col(point).cast("bigint").alias("point_no"), one.alias("got"), zero.alias("new_keys"))
    ends = hits.select(region, F.col(point).cast("bigint").alias("_last"))
    if last_point is not None:
        ends = ends.unionByName(last_point.select(region, F.col(point).cast("bigint").alias("_last")))
    ends = ends.where(F.col(region).isNotNull()).groupBy(region).agg(F.max("_last").alias("_last"))
    every = positions(ends, [region], "_last", "point_no", block).select(
        region, "point_no", zero.alias("got"), zero.alias("new_keys"))
    per_point = (
        results.unionByName(firsts).unionByName(every).where(F.col(region).isNotNull())
        .groupBy(region, "point_no").agg(F.sum("got").alias("got"), F.sum("new_keys").alias("new_keys"))
    )
    # point 0 holds the size of the store: part of the total, not a point of the crawl
    terms = firsts.unionByName(every).select(region, "point_no", "new_keys")
    return running_total(per_point, [region], "point_no", "new_keys", "total", block, terms).where("point_no > 0")


def rolling_yield(df: DataFrame, region: str = "region", point: str = "point_no", value: str = "new_keys",
                  window: int = PLATEAU_WINDOW, warmup: int = PLATEAU_WARMUP_POINTS, out: str = "avg_new",
                  block: int = BLOCK) -> DataFrame:
    """Mean of the last ``window`` points; at point ``warmup`` the window starts afresh."""
    frame = (Window.partitionBy(region, "_block", F.col(point) >= warmup).orderBy(point)
             .rowsBetween(-(window - 1), 0))
    rolled = with_halo(df, point, window - 1, block).withColumn(out, F.avg(value).over(frame))
    return rolled.where(~F.col("_halo")).drop("_block", "_halo")


def plateau_point(df: DataFrame, region: str = "region", point: str = "point_no", value: str = "new_keys",
                  window: int = PLATEAU_WINDOW, min_new_avg: float = PLATEAU_MIN_NEW_AVG,
                  stable: int = PLATEAU_STABLE_POINTS, warmup: int = PLATEAU_WARMUP_POINTS,
                  out: str = "plateau_point", block: int = BLOCK) -> DataFrame:
    """Per region the first point that ends ``stable`` points in a row whose full window had a mean below
    ``min_new_avg``, counted from point ``warmup`` on; null if there is none."""
    by_block = Window.partitionBy(region, "_block").orderBy(point)
    # a streak of full windows looks back over window + stable - 1 points
    rows = with_halo(df.where(F.col(region).isNotNull()), point, window + stable - 2, block)
    flagged = rows.withColumn("_low", (
        # from here on a window holds no point before the warm-up's end
        (F.col(point) >= warmup + window - 1)
        & (F.avg(value).over(by_block.rowsBetween(-(window - 1), 0)) < min_new_avg)
        # a halo row whose own window starts before the halo is only context
        & (F.count("*").over(by_block.rowsBetween(-(window - 1), 0)) == window)).cast("int"))
    streak = F.sum("_low").over(by_block.rowsBetween(-(stable - 1), 0))
    found = flagged.withColumn("_stop", ~F.col("_halo") & (streak == stable))
    return found.groupBy(region).agg(F.min(F.when(F.col("_stop"), F.col(point))).alias(out))


def cap_per_region(hits: DataFrame, region: str, point: str, pos: str, key: str, n: int = TARGET_PER_CITY,
                   existing: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Walk each region's points in order and keep its first ``n`` distinct keys, stored ones included.

    Returns region, key, point and position of the first sighting of each key that is added.
    """
    # stored keys are at point 0, before all others
    place = F.struct(F.col(point).cast("bigint").alias("point_no"), F.col(pos).alias("pos"))
    seen = _keyed(hits, key).where(F.col(region).isNotNull()).select(region, key, place.alias("place"))
    if existing is not None:
        stored = F.struct(F.lit(0).cast("bigint").alias("point_no"), F.lit(None).cast(hits.schema[pos].dataType).alias("pos"))
        seen = seen.unionByName(_keyed(existing, key).select(region, key, stored.alias("place")))
    firsts = seen.groupBy(region, key).agg(F.min("place").alias("place")).select(
        region, key, F.col("place.point_no").alias("point_no"), F.col("place.pos").alias("pos"))
    # totals per point tell which points are reached before the cap; only their keys are ranked, and never the store's
    per_point = firsts.groupBy(region, "point_no").agg(F.count("*").alias("_keys"))
    totals = running_total(per_point, [region], "point_no", "_keys", "_total", block)
    before = F.col("_total") - F.col("_keys")
    reached = totals.where((F.col("point_no") > 0) & (before < n)).select(region, "point_no", before.alias("_before"))
    in_point = Window.partitionBy(region, "point_no").orderBy("pos", key)
    kept = firsts.where("point_no > 0").join(reached, [region, "point_no"]).withColumn(
        "_rank", F.row_number().over(in_point)).where(F.col("_before") + F.col("_rank") <= n)
    return kept.select(region, key, F.col("point_no").alias(point), F.col("pos").alias(pos))


def region_counts(df: DataFrame, region: str, target: int | None = None) -> DataFrame:
    """Rows per region; with a target also whether it was met."""
    counts = df.where(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("rows"))
    return counts if target is None else counts.withColumn("target_met", F.col("rows") >= target)
