"""The chains of operators that the daily jobs run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placewise import constants as K
from placewise.functions import lenient_double, lenient_int, utc_now_seconds
from placewise.operators.aggregates import area_summary_of, argmax_by, kpis, segment_summary, value_counts
from placewise.operators.crawl import cap_per_region, plateau_point, region_counts, rolling_yield, yield_per_point
from placewise.operators.filters import exact_length, filter_places, load_serving
from placewise.operators.joins import assemble_dim, enrich, lookup, restrict_dim, unmapped
from placewise.operators.keyed import insert_new, upsert
from placewise.operators.metrics import binary_metrics, class_report, confusion, pick_threshold, threshold_sweep
from placewise.operators.models import (
    FIT_PARTITIONS, MAX_DEPTH, classifier_table, feature_importance, fit_forest, fit_logistic,
)
from placewise.operators.split import stratified_split
from placewise.operators.topk import top_k
from placewise.session import stage
from placewise.sources.pages import flatten_places

DEMOGRAPHICS = ["population_total", "median_age", "pct_under_18", "pct_65_plus", "median_household_income"]


CRAWL_ORDER = ["point_no", "page_no", "pos"]
PLACE_KEYS = ("city", "place_id")


def collect_new(store: DataFrame, results: DataFrame, keys=PLACE_KEYS) -> DataFrame:
    """The store with the unseen places of parsed search results, first sighting in crawl order; ``fetched_at`` is now."""
    return insert_new(store, flatten_places(results, extra=CRAWL_ORDER), list(keys), CRAWL_ORDER,
                      touch={"fetched_at": utc_now_seconds()})


def collect_all(store: DataFrame, results: DataFrame, keys=PLACE_KEYS) -> DataFrame:
    """The store with all places of a text search: known ones are updated, the last sighting wins. The answers of a
    text search name the formatted address first."""
    rows = flatten_places(results, address_order=("formatted_address", "vicinity"), extra=CRAWL_ORDER)
    update = [c for c in store.columns if c in rows.columns and c not in keys]
    return upsert(store, rows, list(keys), update, CRAWL_ORDER, touch={"fetched_at": utc_now_seconds()})


def collect_capped(store: DataFrame, results: DataFrame, n: int = K.TARGET_PER_CITY, city: str = "city",
                   key: str = "place_id") -> tuple[DataFrame, DataFrame]:
    """The store filled up to ``n`` places a city in crawl order, and the counts against that target."""
    place = F.struct("page_no", "pos")
    hits = results.select(city, "point_no", place.alias("place_no"), F.col(f"place.{key}").alias(key))
    kept = cap_per_region(hits, city, "point_no", "place_no", key, n, existing=store).select(
        city, key, "point_no", "place_no.page_no", "place_no.pos")
    new = flatten_places(results, extra=CRAWL_ORDER).join(kept, [city, key, *CRAWL_ORDER], "left_semi")
    full = insert_new(store, new, [city, key], CRAWL_ORDER, touch={"fetched_at": utc_now_seconds()})
    return full, region_counts(full, city, n)


def crawl_progress(results: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Yield per search point with its rolling mean, and the point at which each city's crawl could stop."""
    hits = results.select("city", "point_no", F.col("place.place_id").alias("place_id"))
    points = yield_per_point(hits, "city", "point_no", "place_id", existing=store)
    return rolling_yield(points, "city"), plateau_point(points, "city")


def zip_demographics(age: DataFrame, income: DataFrame, places: DataFrame, zip_col: str = "zip5") -> DataFrame:
    """Census age and income rows (text) of the zips that occur in ``places``, typed, one row per zip."""
    zips = exact_length(places, zip_col, 5)
    left = restrict_dim(age.withColumnRenamed(K.ZCTA_COLUMN, zip_col), zips, zip_col)
    right = restrict_dim(income.withColumnRenamed(K.ZCTA_COLUMN, zip_col), zips, zip_col)
    table = assemble_dim(left.select(zip_col, *K.AGE_COLUMNS), right.select(zip_col, *K.INCOME_COLUMNS), zip_col)
    table = table.withColumnsRenamed({**K.AGE_COLUMNS, **K.INCOME_COLUMNS})
    return table.withColumns({
        "population_total": lenient_int("population_total"), "median_age": lenient_double("median_age"),
        "pct_under_18": lenient_double("pct_under_18"), "pct_65_plus": lenient_double("pct_65_plus"),
        "median_household_income": lenient_int("median_household_income")})


def city_demographics(places: DataFrame, age: DataFrame, income: DataFrame, mapping=K.CITY_FIPS,
                      city: str = "city") -> tuple[DataFrame, DataFrame]:
    """Typed demographics of the mapped cities, and the cities without a mapping.

    ``age`` and ``income`` are census place rows with their ``state`` and ``place`` codes.
    """
    cities = places.where(F.col(city).isNotNull()).select(city).distinct()
    coded = lookup(cities, mapping, city)
    known = cities.sparkSession.createDataFrame([(c,) for c in mapping], f"`{city}` string")
    codes = ["state", "place"]
    table = coded.join(age, codes, "left").join(income.select(*codes, *K.INCOME_COLUMNS), codes, "left")
    table = table.withColumnsRenamed({**K.AGE_COLUMNS, **K.INCOME_COLUMNS})
    table = table.select(
        city, "census_name", lenient_int("population_total").alias("population_total"),
        lenient_double("median_age").alias("median_age"), lenient_double("pct_under_18").alias("pct_under_18"),
        lenient_double("pct_65_plus").alias("pct_65_plus"),
        lenient_int("median_household_income").alias("median_household_income"),
        F.col("state").alias("census_state_fips"), F.col("place").alias("census_place_fips"))
    return table, unmapped(places, known, city)


def enriched_by_zip(places: DataFrame, demographics: DataFrame, salted: bool = False) -> DataFrame:
    return enrich(places, demographics, "zip5", [*DEMOGRAPHICS, "census_name"], salted=salted, spread=["place_id"])


def zip_analysis(places: DataFrame, demographics: DataFrame) -> DataFrame:
    """Summary per zip: places, mean rating and price, demographics, places per 1000 people."""
    return area_summary_of(places, demographics, "zip5",
                           {"rating": "avg_rating", "price_level": "avg_price_level"},
                           DEMOGRAPHICS, "population_total")


def _served(places: DataFrame, filters: dict) -> DataFrame:
    """What a dashboard page shows: the load rules, then the page's filters."""
    return filter_places(load_serving(places), **filters)


BEST_FIRST = [("rating", -1), ("user_ratings_total", -1), "place_id"]


def _shape(rows: DataFrame, best: int) -> dict[str, DataFrame]:
    shown = [c for c in ("place_id", "name", "city", "rating", "user_ratings_total", "price_level") if c in rows.columns]
    return {"kpis": kpis(rows), "rating_counts": value_counts(rows, "rating", sort="value"),
            "price_counts": value_counts(rows, "price_level", sort="value"),
            "top_places": top_k(rows, BEST_FIRST, best).select(*shown)}


def overview_page(places: DataFrame, **filters) -> dict[str, DataFrame]:
    """Key figures, distributions of ratings, prices and cities, the five best places."""
    rows = _served(places, filters)
    return {**_shape(rows, 5), "city_counts": value_counts(rows, "city")}


def city_page(places: DataFrame, city: str = "All", **filters) -> dict[str, DataFrame]:
    """All cities side by side, or one city's figures, distributions and eight best places."""
    rows = _served(places, {**filters, "city": city})
    return {"city_summary": segment_summary(rows, "city")} if city == "All" else _shape(rows, 8)


def rating_reviews_page(places: DataFrame, **filters) -> dict[str, DataFrame]:
    """Points of rating against reviews, key figures, the eight most reviewed places."""
    rows = _served(places, filters)
    shown = ["place_id", "name", "city", "rating", "user_ratings_total", "price_level"]
    return {"points": rows.select(*shown), "kpis": kpis(rows),
            "most_reviewed": top_k(rows, [("user_ratings_total", -1), "place_id"], 8).select(*shown)}


def insights_page(places: DataFrame, **filters) -> dict[str, DataFrame]:
    """Key figures, the leading price level per metric, the city with most places."""
    rows = _served(places, filters)
    return {"kpis": kpis(rows),
            "price_leaders": argmax_by(segment_summary(rows, "price_level"), "price_level",
                                       ["place_count", "avg_rating", "avg_reviews"]),
            "city_leader": argmax_by(segment_summary(rows, "city"), "city", ["place_count"])}


def price_page(places: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
    """Dashboard price page: segment summary and the leading segment per metric."""
    summary = segment_summary(_served(places, filters), "price_level")
    return summary, argmax_by(summary, "price_level", ["place_count", "avg_rating", "avg_reviews"])


def classify(places: DataFrame, key: str = "place_id", model: str = "forest", test: float = 0.2, seed: int = K.SEED,
             num_trees: int = 300, max_depth: int = MAX_DEPTH, partitions: int = FIT_PARTITIONS) -> dict[str, DataFrame]:
    """Split, fit and judge a high-rating classifier.

    Scored test rows; metrics, confusion and report of the model's own predictions; threshold sweep, the
    chosen threshold, and confusion and report at it.
    """
    table = classifier_table(places).select(key, "high_rated", *K.NUMERIC_FEATURES, *K.CATEGORICAL_FEATURES)
    # fitting passes over the rows many times: the split is written once and then only scanned
    parts = stage(stratified_split(stage(table, "classifier"), "high_rated", key, test, seed), "split")
    train = parts.where("part = 'train'").drop("part")
    held = parts.where("part = 'test'").drop("part")
    if model == "forest":
        fitted = fit_forest(train, "high_rated", K.NUMERIC_FEATURES, K.CATEGORICAL_FEATURES, num_trees, max_depth, seed=seed,
                            partitions=partitions, key=key)
    else:
        fitted = fit_logistic(train, "high_rated", K.NUMERIC_FEATURES, K.CATEGORICAL_FEATURES, partitions=partitions, key=key)
    scored = stage(fitted.score(held), "scored")
    sweep = threshold_sweep(scored, "high_rated", "probability_1")
    chosen = pick_threshold(sweep)
    cut = chosen.select("threshold").scalar()
    judged = scored.withColumn("at_threshold", (F.col("probability_1") >= cut).cast("int"))
    return {
        "classifier": fitted, "train": train, "importance": feature_importance(fitted, train) if model == "forest" else None,
        "scored": scored, "sweep": sweep, "chosen": chosen,
        "metrics": binary_metrics(scored, "high_rated", "prediction"),
        "confusion": confusion(scored, "high_rated", "prediction"),
        "report": class_report(scored, "high_rated", "prediction"),
        "chosen_confusion": confusion(judged, "high_rated", "at_threshold"),
        "chosen_report": class_report(judged, "high_rated", "at_threshold"),
    }
