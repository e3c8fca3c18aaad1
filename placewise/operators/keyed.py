"""Keyed writes as lazy tables: upsert, insert of unseen keys, backfill.

Picking one row per key is ``row_number() = 1``, for which Spark keeps one row per key on the map side
(WindowGroupLimit), so copies of a hot key never travel together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.operators.joins import unseen


def _ordered(order_cols: list, last: bool) -> list[Column]:
    if not order_cols:
        raise ValueError("order_cols is required: which row of a batch wins must not be left to chance")
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return [c.desc_nulls_last() for c in cols] if last else [c.asc_nulls_last() for c in cols]


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    return _one_per_key(df, keys, _ordered(order_cols, last=True))


def first_per_key(df: DataFrame, keys: list[str], order_cols: list) -> DataFrame:
    return _one_per_key(df, keys, _ordered(order_cols, last=False))


def _refuse_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = F.lit(False)
    for key in keys:
        bad = bad | F.col(key).isNull()
    message = F.lit(f"null in key columns {', '.join(keys)}")
    return df.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str], order_cols: list,
           touch: dict[str, Column] | None = None, small_batch: bool = False) -> DataFrame:
    """Last write wins on ``keys``.

    On a conflict ``update_cols`` take the batch value, null included; other columns keep the old one. A new key
    brings its whole batch row. ``touch`` columns are set on every inserted or updated row. Within the batch the row
    that is last in ``order_cols`` wins. Null keys fail the job.

    ``small_batch=True`` plans the same result as left, semi and anti joins, in which Spark may broadcast
    the batch and leave a huge target unshuffled; a full outer join must shuffle both sides.
    """
    touch = touch or {}
    new = latest_per_key(_refuse_null_keys(batch, keys), keys, order_cols)
    brought = [c for c in target.columns if c in batch.columns and c not in keys]
    new = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in brought], F.lit(True).alias("_hit"))
    old = target.withColumn("_had", F.lit(True))
    hit, had = F.col("_hit").isNotNull(), F.col("_had").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in touch:
            return F.when(hit, touch[c]).otherwise(F.col(c)).alias(c)
        if c not in brought:
            return F.col(c)
        takes = hit if c in update_cols else ~had
        return F.when(takes, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    def result(joined: DataFrame) -> DataFrame:
        return joined.select(*map(value, target.columns))

    if not small_batch:
        return result(old.join(new, keys, "full"))
    updated = result(old.join(new, keys, "left"))
    matched = target.select(*keys).join(new.select(*keys), keys, "left_semi")
    absent = new.join(matched, keys, "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in target.schema.fields if f.name not in keys}
    return updated.unionByName(result(absent.withColumns(blank).withColumn("_had", F.lit(None).cast("boolean"))))


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], order_cols: list,
               touch: dict[str, Column] | None = None) -> DataFrame:
    """Target plus the first batch row of each key it lacks; rows with a null or empty-text key are skipped.

    Columns that only the target has are null in the new rows, unless ``touch`` sets them.
    """
    named = batch.na.drop(subset=keys)
    for key in keys:
        named = named.where(F.col(key).cast("string") != "")
    fresh = unseen(first_per_key(named, keys, order_cols), target, keys).withColumns(touch or {})
    return target.unionByName(fresh.select(*[c for c in target.columns if c in fresh.columns]), allowMissingColumns=True)


def _candidates(target: DataFrame, keys: list[str], when_null: str) -> Column:
    cond = F.col(when_null).isNull()
    for key in keys:
        cond = cond & F.col(key).isNotNull()
    return cond


def backfill(target: DataFrame, details: DataFrame, keys: list[str], when_null: str, set_cols: list[str],
             order_cols: list, status: str = "status", ok: str = "OK",
             touch: dict[str, Column] | None = None) -> DataFrame:
    """Rows that lack ``when_null`` take ``set_cols`` from their detail row if its status is ``ok``.

    A null in the detail is written too, and the row stays a candidate. Only candidate rows are shuffled;
    the rest of the target passes through.
    """
    touch = touch or {}
    is_candidate = _candidates(target, keys, when_null)
    last = latest_per_key(details.na.drop(subset=keys), keys, order_cols).where(F.col(status) == ok)
    last = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in set_cols], F.lit(True).alias("_hit"))
    joined = target.where(is_candidate).join(last, keys, "left")
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c in set_cols:
            return F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in touch:
            return F.when(hit, touch[c]).otherwise(F.col(c)).alias(c)
        return F.col(c)

    rest = target.where(~F.coalesce(is_candidate, F.lit(False)))
    return rest.unionByName(joined.select(*[value(c) for c in target.columns]))


def backfill_stats(target: DataFrame, details: DataFrame, keys: list[str], when_null: str, order_cols: list,
                   status: str = "status", ok: str = "OK", retry: str = "OVER_QUERY_LIMIT") -> DataFrame:
    """One row: candidates, candidates with an ``ok`` detail, candidates with any other detail. One whose last answer
    only says to try again counts as neither."""
    last = latest_per_key(details.na.drop(subset=keys), keys, order_cols).select(*keys, F.col(status).alias("_status"))
    todo = target.where(_candidates(target, keys, when_null)).select(*keys).join(last, keys, "left")
    return todo.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_status") == ok).alias("updated"),
        F.count_if(~F.col("_status").isin(ok, retry)).alias("skipped"),
    )
