"""Yield and plateau while the crawl runs: each micro-batch of a crawl log settles the points it brings.

A micro-batch is counted against what earlier ones left, and leaves the same for the next one, all in folders of its own
``batch_id`` (a replay reads the batches before it and overwrites its own, so restarts are harmless):

* ``seen``: region and key of the keys sighted for the first time. Grows with the keys, as any seen-set does;
* ``counts``: per region and point what the batch adds to its results and new keys. Points without results are there, with 0;
* ``recent``: the last points of each region that a window can still reach, whose number does not grow;
* ``stops``: regions whose plateau is reached, once each. Their later rows are dropped, as the crawl has stopped there.

A region's points must land in ascending order, one or several a batch; the last one may go on in the next batch, so it can
reach a plateau only when a later point has landed or the crawl is read as ``closed``. Results that land for an earlier
point are counted there, but do not take back a stop.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from placewise.constants import PLATEAU_MIN_NEW_AVG, PLATEAU_STABLE_POINTS, PLATEAU_WARMUP_POINTS, PLATEAU_WINDOW
from placewise.operators.crawl import plateau_point
from placewise.plans.blocks import BLOCK, positions, running_total

RULE = {"window": PLATEAU_WINDOW, "min_new_avg": PLATEAU_MIN_NEW_AVG, "stable": PLATEAU_STABLE_POINTS,
        "warmup": PLATEAU_WARMUP_POINTS}
COUNTS = "region string, point_no bigint, got bigint, new_keys bigint"
RECENT = "region string, point_no bigint, new_keys bigint"
SEEN = "region string, key string"
STOPS = "region string, plateau_point bigint"


def start_yield(stream: DataFrame, log: str, checkpoint: str, region: str, point: str, key: str,
                existing: DataFrame | None = None, **rule) -> StreamingQuery:
    """Start counting all results that have landed; stops when they are done. ``existing`` holds the store's region and
    key; ``rule`` may set window, min_new_avg, stable and warmup of ``crawl.plateau_point``, the same in every start."""
    rule = {**RULE, **rule}
    reach = rule["window"] + rule["stable"] - 1

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _read(spark, log, "stops", STOPS).where(F.col("batch_id") < batch_id).select("region")
        hits = _named(batch, region, key, F.col(point).cast("bigint").alias("point_no")).where("region is not null")
        hits = hits.join(done, "region", "left_anti")
        known = _read(spark, log, "seen", SEEN).where(F.col("batch_id") < batch_id).select("region", "key")
        if existing is not None:
            known = known.unionByName(_named(existing, region, key))
        before = _read(spark, log, "recent", RECENT).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        before = before.join(done, "region", "left_anti")

        firsts = hits.where("key <> ''").groupBy("region", "key").agg(F.min("point_no").alias("point_no"))
        fresh = _write(firsts.join(known, ["region", "key"], "left_anti"), log, "seen", batch_id)
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        opened = before.groupBy("region").agg(F.max("point_no").alias("_open"))
        ends = hits.groupBy("region").agg(F.max("point_no").alias("_last")).join(opened, "region", "left")
        skipped = ends.withColumn("_open", F.coalesce("_open", zero)).withColumn("_n", F.col("_last") - F.col("_open"))
        skipped = skipped.where("_n > 0")
        every = positions(skipped, ["region", "_open"], "_n", "_i", BLOCK).withColumn("point_no", F.col("_open") + F.col("_i"))
        counts = (
            hits.select("region", "point_no", one.alias("got"), zero.alias("new_keys"))
            .unionByName(fresh.select("region", "point_no", zero.alias("got"), one.alias("new_keys")))
            .unionByName(every.select("region", "point_no", zero.alias("got"), zero.alias("new_keys")))
            .groupBy("region", "point_no").agg(F.sum("got").alias("got"), F.sum("new_keys").alias("new_keys")))
        counts = _write(counts, log, "counts", batch_id)

        # results for points before the carried ones cannot move a window any more
        first = before.groupBy("region").agg(F.min("point_no").alias("_first"))
        added = counts.join(first, "region", "left").where("_first is null or point_no >= _first")
        rows = before.unionByName(added.select("region", "point_no", "new_keys")).groupBy("region", "point_no").agg(
            F.sum("new_keys").alias("new_keys"))
        last = rows.groupBy("region").agg(F.max("point_no").alias("_last"))
        rows = rows.join(last, "region")
        stops = plateau_point(rows.where("point_no < _last").drop("_last"), **rule)
        stops = _write(stops.where("plateau_point is not null"), log, "stops", batch_id)
        carried = rows.where(F.col("point_no") > F.col("_last") - reach).drop("_last")
        _write(carried.join(stops, "region", "left_anti"), log, "recent", batch_id)

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_yield(spark: SparkSession, log: str, existing: DataFrame | None = None, region: str = "region",
               key: str = "key") -> DataFrame:
    """Per point ``got``, ``new_keys`` and ``total`` so far, as ``crawl.yield_per_point`` gives them; of a region that
    has stopped up to the batch in which it did."""
    rows = _read(spark, log, "counts", COUNTS).groupBy("region", "point_no").agg(
        F.sum("got").alias("got"), F.sum("new_keys").alias("new_keys"))
    if existing is not None:
        stored = _named(existing, region, key).where("key <> ''").distinct().groupBy("region").agg(
            F.count("*").alias("new_keys"))
        zero = F.lit(0).cast("bigint")  # the store is point 0: part of the total, not a point of the crawl
        rows = rows.unionByName(stored.select("region", zero.alias("point_no"), zero.alias("got"), "new_keys"))
    return running_total(rows, ["region"], "point_no", "new_keys", "total").where("point_no > 0")


def read_plateaus(spark: SparkSession, log: str, closed: bool = False, **rule) -> DataFrame:
    """region and ``plateau_point``, null where there is none so far. ``closed``: nothing lands any more, so that the last
    point of each region counts too."""
    regions = _read(spark, log, "counts", COUNTS).select("region").distinct()
    found = _read(spark, log, "stops", STOPS).select("region", "plateau_point")
    if closed:
        recent = _read(spark, log, "recent", RECENT)
        recent = recent.where(F.col("batch_id") == recent.agg(F.max("batch_id")).scalar()).drop("batch_id")
        recent = recent.join(found.select("region"), "region", "left_anti")
        found = found.unionByName(plateau_point(recent, **{**RULE, **rule}).where("plateau_point is not null"))
    return regions.join(found, "region", "left")


def _named(df: DataFrame, region: str, key: str, *more) -> DataFrame:
    return df.select(F.col(region).cast("string").alias("region"), F.col(key).cast("string").alias("key"), *more)


def _write(df: DataFrame, log: str, kind: str, batch_id: int) -> DataFrame:
    path = f"{log}/{kind}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(spark: SparkSession, log: str, kind: str, schema: str) -> DataFrame:
    full = f"{schema}, batch_id bigint"
    try:
        return spark.read.schema(full).parquet(f"{log}/{kind}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
