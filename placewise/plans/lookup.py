"""Tables with one row per column or feature, used as values.

A fitted constant has a row for each of a few named columns. As a scalar subquery it is planned once and reaches every
row without a join. Tables whose size follows the data (a row per class, a row per key) are joined instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scalar_map(df: DataFrame, key: str, values: list[str]) -> Column:
    """``map<key, struct<values>>`` of a table that has a row per column or feature."""
    entry = F.struct(F.col(key).alias("key"), F.struct(*values).alias("value"))
    return df.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.collect_list(entry))).scalar()


def attach(df: DataFrame, found: Column, key: str, out: str) -> DataFrame:
    """Adds the looked-up struct as a column, so that a plan with several uses holds the subquery once."""
    return df.withColumn(out, F.element_at(found, F.col(key)))
