"""Enrichment joins.

No join carries a broadcast hint. Spark broadcasts a side that it has measured to be under ``spark.sql.autoBroadcastJoinThreshold``;
a larger one is shuffled, and skewed partitions of the fact side are split by adaptive execution
(``forceOptimizeSkewedJoin``) or, on request, salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placewise.plans.skew import salted_left_join


def enrich(fact: DataFrame, dim: DataFrame, on: str, cols: list[str] | None = None,
           salted: bool = False, spread: list[str] | None = None) -> DataFrame:
    """Left join: every fact row stays; null and unmapped keys get null attributes.

    ``salted=True`` is for a dimension too large to broadcast under a fact with hot (or many null) keys; rows are
    spread by a hash of the ``spread`` columns, all if not given.
    """
    right = dim if cols is None else dim.select(on, *cols)
    if salted:
        return salted_left_join(fact, right, on, spread or fact.columns)
    return fact.join(right, on, "left")


def assemble_dim(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Attribute table completed with the columns of another one."""
    return left.join(right, on, "left")


def restrict_dim(dim: DataFrame, fact: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Dimension rows whose key occurs in the fact table."""
    keys = fact.select(F.col(key or on).alias(on)).where(F.col(on).isNotNull()).distinct()
    return dim.join(keys, on, "left_semi")


def unseen(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose keys the target does not hold."""
    return batch.join(target.select(*keys), keys, "left_anti")


def unmapped(fact: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Distinct fact keys the dimension lacks, sorted."""
    keys = fact.where(F.col(on).isNotNull()).select(on).distinct()
    return keys.join(dim.select(on), on, "left_anti").orderBy(on)


def lookup(df: DataFrame, mapping: dict[str, dict[str, str]], on: str) -> DataFrame:
    """Inner join with a dictionary ``key -> {column: text}``; unmapped rows are left out, all of them if it is empty."""
    fields = list(next(iter(mapping.values()), {}))
    rows = [(key, *[attrs[f] for f in fields]) for key, attrs in mapping.items()]
    schema = ", ".join(f"`{name}` string" for name in [on, *fields])
    return df.join(df.sparkSession.createDataFrame(rows, schema), on)
