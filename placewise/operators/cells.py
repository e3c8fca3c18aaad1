"""Facts cut into cells of a few filter columns, from which the figures of any filter on those columns follow.

A cell holds its rows' count, sums with their counts, and exact bitmaps of whole-number ids. All of them merge, so key
figures and distinct counts of every page filter come from the cells without reading the facts again, and cells of new facts
are merged into the old ones. Bitmaps cut the ids into buckets of 32,768, a row of 4 KB each (mostly zeros, which Parquet
compresses, where a cell has few of a bucket's ids): meant for dense ids and cells that are few beside the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cell_sums(df: DataFrame, cells: list[str], values: list[str]) -> DataFrame:
    """One row per combination of ``cells``, nulls too: ``rows`` and, per value, ``sum_`` and ``n_`` of its non-nulls."""
    sums = [f for v in values for f in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))]
    return df.groupBy(*cells).agg(F.count("*").alias("rows"), *sums)


def cell_bitmaps(df: DataFrame, cells: list[str], key: str) -> DataFrame:
    """One row per combination of ``cells`` and bucket of the ids in ``key``: the ids seen there, as a bitmap.

    Ids are whole numbers, negative ones too; null ids are in no bitmap. Combinations with null ids only have no row.
    """
    key_of = F.col(key).cast("bigint")
    ids = df.where(key_of.isNotNull()).select(*cells, F.bitmap_bucket_number(key_of).alias("bucket"),
                                              F.bitmap_bit_position(key_of).alias("_bit"))
    return ids.groupBy(*cells, "bucket").agg(F.bitmap_construct_agg("_bit").alias("ids"))


def merge_sums(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of several loads, or finer cells, as cells of ``by``."""
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cells.columns if c == "rows" or c[:4] == "sum_" or c[:2] == "n_"])


def merge_bitmaps(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct_of_cells(cells: DataFrame, by: list[str] | None = None, out: str = "distinct_count") -> DataFrame:
    """Exact number of distinct ids over the given cells, one row in all or one per combination of ``by``."""
    found = merge_bitmaps(cells, by or []).groupBy(*(by or [])).agg(F.sum(F.bitmap_count("ids")).alias(out))
    return found.withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def kpis_of_cells(cells: DataFrame, rating: str = "rating", reviews: str = "user_ratings_total", city: str = "city") -> DataFrame:
    """The row of ``aggregates.kpis`` from cells that have ``city`` among their columns, already filtered."""
    def mean(value: str) -> Column:
        n = F.sum(f"n_{value}")
        return F.when(n > 0, F.sum(f"sum_{value}").cast("double") / n)

    return cells.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("places"), mean(rating).alias("avg_rating"),
                     mean(reviews).alias("avg_reviews"), F.count_distinct(city).alias("cities"))
