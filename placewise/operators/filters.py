"""Projections, predicates and the serving-side filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a value in every listed column (NaN counts as missing)."""
    return df.na.drop(subset=cols)


def exclude_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values))


def exact_length(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.where(F.length(col) == n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()


def binary_target(df: DataFrame, col: str, cut: float, out: str) -> DataFrame:
    """0/1 label ``col >= cut`` for rows that have a value."""
    return df.where(F.col(col).isNotNull()).withColumn(out, (F.col(col) >= F.lit(cut)).cast("int"))


def load_serving(df: DataFrame, city="city", price="price_level", rating="rating",
                 reviews="user_ratings_total", null_city_label: str | None = "nan") -> DataFrame:
    """City as text, unknown price 0, unrated rows dropped, unknown review count 0."""
    city_text = F.col(city).cast("string")
    if null_city_label is not None:
        city_text = F.coalesce(city_text, F.lit(null_city_label))
    return (
        df.where(F.col(rating).isNotNull())
        .withColumn(city, city_text)
        .withColumn(price, F.coalesce(F.col(price).cast("int"), F.lit(0)))
        .withColumn(reviews, F.coalesce(F.col(reviews), F.lit(0).cast(df.schema[reviews].dataType)))
    )


def filter_places(df: DataFrame, city: str = "All", price_levels: list[int] | None = None,
                  rating_range: tuple[float, float] | None = None, keyword: str = "", literal: bool = False,
                  city_col="city", price_col="price_level", rating_col="rating", name_col="name") -> DataFrame:
    """Dashboard filter. ``All``, an empty price list, no range and an empty keyword filter nothing.

    The keyword is a case-insensitive regular expression unless ``literal``; null names never match.
    """
    if city != "All":
        df = df.where(F.col(city_col) == city)
    if price_levels:
        df = df.where(F.col(price_col).isin(list(price_levels)))
    if rating_range:
        df = df.where(F.col(rating_col).between(*rating_range))
    if keyword:
        pattern = re.sub(r"([^\w\s])", r"\\\1", keyword) if literal else keyword
        df = df.where(F.coalesce(F.col(name_col).rlike("(?i)" + pattern), F.lit(False)))
    return df


def filter_domains(df: DataFrame, city="city", price="price_level", rating="rating") -> DataFrame:
    """The choices a filter offers, one row each: every city, every price level, lowest and highest rating; none for an
    empty table.

    Rows, not arrays, so a column with many values does not have to fit into one row.
    """
    # one scan: the three groupings are combined before the shuffle
    found = df.groupingSets([[city], [price], []], city, price).agg(
        F.min(rating).cast("double").alias("lo"), F.max(rating).cast("double").alias("hi"), F.grouping_id().alias("which"))
    none = F.lit(None)

    def choice(domain: str, text: Column, number: Column) -> Column:
        return F.struct(F.lit(domain).alias("domain"), text.cast("string").alias("text_value"),
                        number.cast("double").alias("number_value"))

    rows = (
        F.when((F.col("which") == 1) & F.col(city).isNotNull(), F.array(choice("city", F.col(city), none)))
        .when((F.col("which") == 2) & F.col(price).isNotNull(), F.array(choice("price_level", none, F.col(price))))
        .when(F.col("which") == 3, F.array(choice("min_rating", none, F.col("lo")), choice("max_rating", none, F.col("hi"))))
    )
    return found.select(F.inline(rows)).orderBy("domain", "text_value", "number_value")
