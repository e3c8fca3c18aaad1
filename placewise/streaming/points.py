"""Landed search pages as a stream: a point reaches the log once all its pages are good.

Pages of a point may land in any batch and order, and failed attempts are tried again later. What a micro-batch cannot
settle is keyed state: lines that wait, written beside those that are done and read again by the next batch.
Each batch writes its own ``batch_id`` folder, cut by ``outcome``:

* ``whole``: pages 1 to the last (the one without a next page, or page ``max_pages``), the last attempt at each good;
* ``waiting``: the lines of points that still lack a page or whose last attempt at one failed;
* ``given_up``: the same, but nothing has landed for them for longer than ``patience``;
* ``unreadable``: lines that are not JSON. A point they name never becomes whole, whenever they land.

A batch that is replayed after a crash reads the state of the batch before it and overwrites its own folder, so restarts
are harmless. Time is landing time: a point is given up against the latest file landed, not against a clock, and so never
twice differently. State is the waiting lines alone; it is bounded by what lands within ``patience``. A finished
point that is searched again is a new point to the stream; of the attempts at a page the log's reader takes the last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from placewise.constants import MAX_PAGES
from placewise.schemas import SEARCH_PAGE
from placewise.sources.pages import last_attempts, search_results

LINE = f"{SEARCH_PAGE}, _corrupt string, landed_at timestamp"
STATE = f"{LINE}, batch_id bigint, outcome string"


def read_page_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Landed lines with the time at which their file landed."""
    lines = (
        spark.readStream.schema(SEARCH_PAGE + ", _corrupt string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").options(**options).json(path))
    return lines.withColumn("landed_at", F.col("_metadata.file_modification_time"))


def start_points(stream: DataFrame, log: str, checkpoint: str, patience: str = "1 day",
                 max_pages: int = MAX_PAGES) -> StreamingQuery:
    """Start settling all lines that have landed; stops when they are done."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        before = read_state(batch.sparkSession, log, batch_id - 1).where("outcome = 'waiting'")
        lines = batch.unionByName(before.drop("batch_id", "outcome"))
        settled(lines, patience, max_pages).write.mode("overwrite").partitionBy("outcome").parquet(
            f"{log}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def settled(lines: DataFrame, patience: str, max_pages: int) -> DataFrame:
    """The last attempt at each page, and the ``outcome`` of its point."""
    columns = lines.columns
    latest = lines.agg(F.max("landed_at")).scalar()
    point = last_attempts(lines, max_pages).withColumn("_last", F.expr("max(landed_at) over (partition by city, point_no)"))
    late = F.col("_last") + F.expr(f"interval {patience}") < latest
    outcome = F.when(F.col("_unreadable"), "unreadable").when(F.col("_whole"), "whole").when(late, "given_up")
    return point.withColumn("outcome", outcome.otherwise("waiting")).select(*columns, "outcome")


def read_state(spark: SparkSession, log: str, batch_id: int | None = None) -> DataFrame:
    """The lines of one batch, or of all batches; empty before the first one."""
    try:
        path = log if batch_id is None else f"{log}/batch_id={batch_id}"
        return spark.read.schema(STATE).option("basePath", log).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def whole_points(spark: SparkSession, log: str) -> DataFrame:
    """Lines of all whole points, without those of points that an unreadable line names."""
    state = read_state(spark, log)
    broken = state.where("outcome = 'unreadable'").select("city", "point_no").distinct()
    return state.where("outcome = 'whole'").join(broken, ["city", "point_no"], "left_anti")


def read_points(spark: SparkSession, log: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """The results of all whole points, as ``read_search_pages`` gives them."""
    return search_results(whole_points(spark, log).drop("batch_id", "outcome"), max_pages)


def open_points(spark: SparkSession, log: str) -> DataFrame:
    """city, point_no, pages landed and outcome (waiting or given_up) of the points not settled yet, or never."""
    state = read_state(spark, log)
    last = state.agg(F.max("batch_id")).scalar()
    open_now = (F.col("outcome") == "given_up") | ((F.col("outcome") == "waiting") & (F.col("batch_id") == last))
    return state.where(open_now).groupBy("city", "point_no", "outcome").agg(F.count("page_no").alias("pages"))
