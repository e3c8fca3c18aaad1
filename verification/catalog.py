"""Every registered query: a Spark function over the test tables and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from verification.standins import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under its own name."""
    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Doubles whose last bits depend on the order of summation, rounded for the comparison."""
    wanted = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in wanted})


def load_all() -> None:
    from verification import q_areas, q_crawl, q_models, q_pages, q_sources, q_tables  # noqa: F401
