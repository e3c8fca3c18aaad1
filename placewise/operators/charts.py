"""The tables that charts plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def valid_areas(df: DataFrame, population="population_total", income="median_household_income") -> DataFrame:
    """Areas with a population and a real income (census marks a missing one with a negative number)."""
    return df.where(F.col(population).isNotNull() & (F.col(income) > 0))


def zip_scatter(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Long form: area, x name, y name, x, y for each pair of columns; incomplete points left out."""
    points = [F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(x).cast("double").alias("x"),
                       F.col(y).cast("double").alias("y")) for x, y in pairs]
    return df.select(key, F.inline(F.array(*points))).where("x is not null and y is not null")


def rating_review_points(df: DataFrame, rating="rating", reviews="user_ratings_total", extra=("city",)) -> DataFrame:
    """Points for a logarithmic review axis: rated places with at least one review."""
    return df.where(F.col(rating).isNotNull() & (F.col(reviews) > 0)).select(*extra, reviews, rating)


def cluster_points(clustered: DataFrame, x="rating", y="price_level", cluster="cluster") -> DataFrame:
    return clustered.select(x, y, cluster)
