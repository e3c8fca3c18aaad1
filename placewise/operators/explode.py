"""Multi-valued text columns to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placewise.functions import prettify
from placewise.operators.aggregates import count_by
from placewise.operators.filters import exclude_values
from placewise.operators.topk import top_k, top_k_per_group


def explode_json_array(df: DataFrame, col: str, out: str) -> DataFrame:
    """One row per element of a JSON array of text. Malformed text, other JSON and null elements give none."""
    items = F.from_json(F.col(col), "array<string>")
    return df.withColumn(out, F.explode(items)).where(F.col(out).isNotNull())


def explode_delimited(df: DataFrame, col: str, out: str) -> DataFrame:
    """Strip brackets and quotes, split at commas, trim, lower-case. ``[]`` gives one empty text."""
    bare = F.regexp_replace(F.col(col), r"[\[\]'\"]", "")
    parts = df.where(F.col(col).isNotNull()).withColumn(out, F.explode(F.split(bare, ",")))
    return parts.withColumn(out, F.lower(F.trim(F.col(out))))


def top_types(df: DataFrame, col: str, exclude: list[str], k: int = 10) -> DataFrame:
    tags = exclude_values(explode_json_array(df.select(col), col, "type"), "type", exclude)
    return top_k(count_by(tags, ["type"]), [("count", -1), "type"], k)


def top_types_per_group(df: DataFrame, group: str, col: str, exclude: list[str], k: int = 5) -> DataFrame:
    tags = exclude_values(explode_json_array(df.select(group, col), col, "type"), "type", exclude)
    return top_k_per_group(count_by(tags, [group, "type"]), group, [("count", -1), "type"], k)


def top_split_types_per_group(df: DataFrame, group: str, col: str, exclude: list[str], k: int = 5) -> DataFrame:
    """As above for the bracket-stripped reading; underscores become spaces after the exclusion."""
    tags = exclude_values(explode_delimited(df.select(group, col), col, "type"), "type", exclude)
    tags = tags.withColumn("type", prettify("type"))
    return top_k_per_group(count_by(tags, [group, "type"]), group, [("count", -1), "type"], k)
