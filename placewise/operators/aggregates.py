"""Group summaries. Every one combines on the map side, so a hot group sends one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewise.functions import per_thousand


def _has(key: str) -> Column:
    return F.col(key).isNotNull()


def area_summary(df: DataFrame, key: str, means: dict[str, str], carry: list[str], population: str,
                 count: str = "place_count", density: str = "places_per_1000_people",
                 digits: int = 3) -> DataFrame:
    """Per area: rows, rounded means (``{column: output}``), ``max`` of attributes, rows per 1000 people."""
    return df.where(_has(key)).groupBy(key).agg(
        F.count("*").alias(count),
        *[F.round(F.avg(c), digits).alias(out) for c, out in means.items()],
        *[F.max(c).alias(c) for c in carry],
        per_thousand(F.count("*"), F.max(population), digits).alias(density),
    )


def area_summary_of(fact: DataFrame, dim: DataFrame, key: str, means: dict[str, str], carry: list[str],
                    population: str, count: str = "place_count", density: str = "places_per_1000_people",
                    digits: int = 3) -> DataFrame:
    """``area_summary(enrich(fact, dim, key))`` with the aggregation moved below the join.

    The fact table is reduced to one row per area before anything is joined, so neither its rows nor a hot
    area cross the join. A dimension that repeats a key repeats each of its fact rows equally, which leaves
    the means alone and multiplies the count.
    """
    areas = fact.where(_has(key)).groupBy(key).agg(
        F.count("*").alias("_rows"), *[F.round(F.avg(c), digits).alias(out) for c, out in means.items()])
    wanted = list(dict.fromkeys([*carry, population]))
    attrs = dim.where(_has(key)).groupBy(key).agg(
        F.count("*").alias("_copies"), *[F.max(c).alias(c) for c in wanted])
    joined = areas.join(attrs, key, "left").withColumn(
        count, F.col("_rows") * F.coalesce(F.col("_copies"), F.lit(1)))
    return joined.select(key, count, *means.values(), *carry,
                         per_thousand(F.col(count), F.col(population), digits).alias(density))


def mean_by(df: DataFrame, key: str, measure: str, out: str | None = None, desc: bool = True,
            key_type: str | None = None) -> DataFrame:
    """Mean of a measure per key, null keys and measures left out; sorted by the mean, then by key."""
    out = out or f"avg_{measure}"
    rows = df.where(_has(key) & _has(measure))
    if key_type:
        rows = rows.withColumn(key, F.col(key).cast(key_type))
    order = F.col(out).desc() if desc else F.col(out).asc()
    return rows.groupBy(key).agg(F.avg(measure).alias(out)).orderBy(order, key)


def count_by(df: DataFrame, keys: list[str], out: str = "count") -> DataFrame:
    return df.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias(out))


def segment_summary(df: DataFrame, key: str, id_col="place_id", rating="rating",
                    reviews="user_ratings_total") -> DataFrame:
    """Per segment: places with an id, mean rating, mean review count."""
    return df.where(_has(key)).groupBy(key).agg(
        F.count(id_col).alias("place_count"), F.avg(rating).alias("avg_rating"),
        F.avg(reviews).alias("avg_reviews")).orderBy(key)


def group_density(df: DataFrame, key: str, population: str, carry: list[str],
                  count: str = "place_count", density: str = "density_per_1000") -> DataFrame:
    """Per area over complete rows: rows, mean population and attributes, rows per 1000 people."""
    wanted = [population, *[c for c in carry if c != population]]
    return df.na.drop(subset=[key, *wanted]).groupBy(key).agg(
        F.count("*").alias(count), *[F.avg(c).alias(c) for c in wanted],
        per_thousand(F.count("*"), F.avg(population), None).alias(density))


def group_density_of(fact: DataFrame, dim: DataFrame, on: str, key: str, population: str, carry: list[str],
                     count: str = "place_count", density: str = "density_per_1000") -> DataFrame:
    """``group_density(enrich(fact, dim, on), key, ...)`` with the fact rows counted per key before the join.

    Several ``on`` keys may share one area (aliases); the means weight each of them by its row count.
    """
    wanted = [population, *[c for c in carry if c != population]]
    rows = fact.where(_has(on)).groupBy(on).agg(F.count("*").alias("_rows"))
    joined = rows.join(dim.na.drop(subset=[key, *wanted]), on)
    weight = F.sum("_rows")
    return joined.groupBy(key).agg(
        weight.alias(count),
        *[(F.sum(F.col(c).cast("double") * F.col("_rows")) / weight).alias(c) for c in wanted],
        per_thousand(weight, F.sum(F.col(population).cast("double") * F.col("_rows")) / weight, None).alias(density))


def kpis(df: DataFrame, rating="rating", reviews="user_ratings_total", city="city") -> DataFrame:
    """One row: places, mean rating, mean reviews, cities. Means are null on empty input."""
    return df.agg(F.count("*").alias("places"), F.avg(rating).alias("avg_rating"),
                  F.avg(reviews).alias("avg_reviews"), F.count_distinct(city).alias("cities"))


def distinct_count(df: DataFrame, col: str, out: str = "distinct_count") -> DataFrame:
    return df.agg(F.count_distinct(col).alias(out))


def value_counts(df: DataFrame, col: str, sort: str = "count", dropna: bool = True, k: int | None = None,
                 out: str = "count") -> DataFrame:
    """Rows per value, sorted by ``value`` or by ``count`` (most first, then value); optionally the top k."""
    if sort not in ("count", "value"):
        raise ValueError("sort is 'count' or 'value'")
    rows = df.where(_has(col)) if dropna else df
    counts = rows.groupBy(col).agg(F.count("*").alias(out))
    by_value = F.col(col).asc_nulls_last()
    counts = counts.orderBy(by_value) if sort == "value" else counts.orderBy(F.col(out).desc(), by_value)
    return counts.limit(k) if k is not None else counts


def argmax_by(summary: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row: for each metric the key that has its largest value, the smallest key on ties."""
    return summary.agg(*[
        F.min(F.when(F.col(m).isNotNull(), F.struct(-F.col(m), F.col(key).alias("key"))))["key"].alias(f"top_{m}")
        for m in metrics])


def profile_groups(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.where(_has(key)).groupBy(key).agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"avg_{c}") for c in cols]).orderBy(key)


def null_profile(df: DataFrame, k: int = 20) -> DataFrame:
    """Null (or NaN) count of the k columns with the most, and the table's row and column counts."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    missing = {c: F.col(c).isNull() | F.isnan(c) if c in numbers else F.col(c).isNull() for c in df.columns}
    counts = df.agg(F.count("*").alias("row_count"), *[F.count_if(m).alias(c) for c, m in missing.items()])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns]
    return (
        counts.select("row_count", F.inline(F.array(*entries)))
        .select("column_name", "null_count", "row_count", F.lit(len(df.columns)).alias("column_count"))
        .orderBy(F.col("null_count").desc(), "column_name").limit(k)
    )
