"""Landed files to an append-only log of batches, and the table that follows from it.

Rewriting a huge target for every micro-batch would cost the whole table each time. A micro-batch is
therefore reduced to one row per key and written to its own ``batch_id`` folder; a replayed batch overwrites
its folder, so restarts are harmless. The current table is the base with the log applied by the same
operators as in batch, and can be folded into a new base whenever that is cheap.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from placewise.operators.keyed import first_per_key, insert_new, latest_per_key, upsert
from placewise.sources.tables import replace_table


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def start_ingest(source: DataFrame, log: str, keys: list[str], order_cols: list, checkpoint: str,
                 mode: str = "upsert") -> StreamingQuery:
    """Start applying all files that have landed; stops when they are done. ``mode``: upsert or insert."""
    if mode not in ("upsert", "insert"):
        raise ValueError("mode is 'upsert' or 'insert'")
    pick = latest_per_key if mode == "upsert" else first_per_key

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = pick(batch.na.drop(subset=keys) if mode == "insert" else batch, keys, order_cols)
        rows.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return (source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All batches written so far; empty before the first one."""
    full = f"{schema}, batch_id bigint"
    try:
        return spark.read.schema(full).parquet(log)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def current_table(base: DataFrame, log: DataFrame, keys: list[str], order_cols: list,
                  update_cols: list[str] | None = None, mode: str = "upsert") -> DataFrame:
    """The base with the log applied: later batches win (upsert) or earlier ones do (insert)."""
    order = ["batch_id", *order_cols]
    if mode == "upsert":
        cols = update_cols or [c for c in base.columns if c not in keys]
        return upsert(base, log, keys, cols, order)
    return insert_new(base, log, keys, order)


def compact(base: DataFrame, log: DataFrame, path: str, keys: list[str], order_cols: list,
            update_cols: list[str] | None = None, mode: str = "upsert") -> DataFrame:
    """Folds the log into a new base table at ``path``. The folded batches are the caller's to drop: applying them
    again changes nothing, so a crash in between does no harm."""
    return replace_table(current_table(base, log, keys, order_cols, update_cols, mode), path)


def stream_new_keys(stream: DataFrame, keys: list[str], event_time: str | None = None,
                    delay: str | None = None) -> DataFrame:
    """First row of each key. State grows with the keys, as a seen-set does, unless ``event_time`` and ``delay``
    let Spark forget a key after that long."""
    rows = stream.na.drop(subset=keys)
    if event_time is None:
        return rows.dropDuplicates(keys)
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return timed.dropDuplicatesWithinWatermark(keys)
