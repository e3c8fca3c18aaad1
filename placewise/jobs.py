"""The daily jobs as commands, for spark-submit.

    spark-submit placewise/jobs.py grid --out O
    spark-submit placewise/jobs.py collect [--store S] --pages P --out O
    spark-submit placewise/jobs.py collect-capped [--store S] --pages P --out O
    spark-submit placewise/jobs.py collect-stream [--store S] --pages P --log L --out O
    spark-submit placewise/jobs.py text-search [--store S] --pages P --out O
    spark-submit placewise/jobs.py backfill --store S --details D --out O
    spark-submit placewise/jobs.py zips --places P --age A --income I --out O
    spark-submit placewise/jobs.py cities --places P --age A --income I --out O
    spark-submit placewise/jobs.py statistics --zips Z --out O
    spark-submit placewise/jobs.py insights --places P --out O
    spark-submit placewise/jobs.py clusters --places P --out O
    spark-submit placewise/jobs.py classify --places P --out O [--model logistic]

Tables are Parquet folders. Each output table is a folder below ``--out``, which must not hold an input.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise import constants as K
from placewise.functions import log_of, zip5
from placewise.operators import aggregates as A, charts, explode as E, joins as J, keyed as W, models as M
from placewise.operators import grid as G, quantiles as Q, stats as S, topk as TK
from placewise.operators.crawl import region_counts
from placewise.operators.filters import load_serving
from placewise.plans import pipelines as P
from placewise.schemas import PLACES
from placewise.session import apply_settings
from placewise.sources import pages, tables
from placewise.streaming import points

SCATTER = [("median_household_income", "avg_price_level"), ("median_household_income", "avg_rating"),
           ("median_household_income", "places_per_1000_people"), ("median_age", "places_per_1000_people")]
CITY_FACT = ["place_id", "city", "name", "rating", "user_ratings_total", "price_level", "business_status", "types"]


def _store(spark: SparkSession, a) -> DataFrame:
    return tables.read_table(spark, a.store) if a.store else spark.createDataFrame([], PLACES)


def grid(spark: SparkSession, a) -> dict[str, DataFrame]:
    """The points to search: a fine grid for crawls that stop by themselves, a coarse one for capped crawls."""
    return {"plateau_points": G.coverage_grid(G.regions_table(spark, K.PLATEAU_REGIONS)),
            "target_points": G.coverage_grid(G.regions_table(spark, K.TARGET_REGIONS))}


def collect(spark: SparkSession, a) -> dict[str, DataFrame]:
    lines, store = pages.read_page_lines(spark, a.pages), _store(spark, a)
    results = pages.search_results(lines)
    progress, stops = P.crawl_progress(results, store)
    return {"places": P.collect_new(store, results), "progress": progress, "stops": stops,
            "unreadable": pages.unreadable_lines(lines)}


def collect_capped(spark: SparkSession, a) -> dict[str, DataFrame]:
    lines, store = pages.read_page_lines(spark, a.pages), _store(spark, a)
    places, counts = P.collect_capped(store, pages.search_results(lines))
    return {"places": places, "counts": counts, "unreadable": pages.unreadable_lines(lines)}


def collect_stream(spark: SparkSession, a) -> dict[str, DataFrame]:
    """Settles the pages landed since the last run, then folds all whole points into the store. Known places are not
    inserted twice, so points folded before change nothing."""
    points.start_points(points.read_page_stream(spark, a.pages), a.log, f"{a.log.rstrip('/')}_checkpoint").awaitTermination()
    return {"places": P.collect_new(_store(spark, a), points.read_points(spark, a.log)),
            "open_points": points.open_points(spark, a.log)}


def text_search(spark: SparkSession, a) -> dict[str, DataFrame]:
    """A failed page fails the job, and nothing is written."""
    places = P.collect_all(_store(spark, a), pages.read_search_pages(spark, a.pages, on_error="fail"))
    return {"places": places, "counts": region_counts(places, "city")}


def backfill(spark: SparkSession, a) -> dict[str, DataFrame]:
    store, details = tables.read_table(spark, a.store), pages.read_place_details(spark, a.details)
    keys, order = ["city", "place_id"], ["attempt"]
    for name, dtype in [("postal_code", "string"), ("details_fetched_at", "timestamp")]:
        if name not in store.columns:
            store = store.withColumn(name, F.lit(None).cast(dtype))
    filled = W.backfill(store, details, keys, "postal_code", ["postal_code", "formatted_address"], order,
                        touch={"details_fetched_at": F.date_trunc("second", F.current_timestamp())})
    return {"places": filled.withColumn("zip5", zip5("postal_code")),
            "counts": W.backfill_stats(store, details, keys, "postal_code", order)}


def zips(spark: SparkSession, a) -> dict[str, DataFrame]:
    places = tables.read_table(spark, a.places)
    age = tables.read_header_rows_json(spark, a.age, [K.ZCTA_COLUMN, *K.AGE_COLUMNS])
    income = tables.read_header_rows_json(spark, a.income, [K.ZCTA_COLUMN, *K.INCOME_COLUMNS])
    demographics = P.zip_demographics(age, income, places)
    return {"zcta_demographics": demographics, "places_by_zip": P.enriched_by_zip(places, demographics),
            "zip_analysis": P.zip_analysis(places, demographics)}


def cities(spark: SparkSession, a) -> dict[str, DataFrame]:
    places = tables.read_table(spark, a.places, CITY_FACT)
    codes = ["state", "place"]
    age = tables.read_header_rows_json(spark, a.age, [*K.AGE_COLUMNS, *codes])
    income = tables.read_header_rows_json(spark, a.income, [*K.INCOME_COLUMNS, *codes])
    demographics, missing = P.city_demographics(places, age, income)
    return {"city_demographics": demographics, "places_by_city": J.enrich(places, demographics, "city"),
            "cities_without_codes": missing}


def statistics(spark: SparkSession, a) -> dict[str, DataFrame]:
    areas = charts.valid_areas(tables.read_table(spark, a.zips)).withColumn(
        "log_income", log_of("median_household_income"))
    priced = areas.where("avg_price_level > 0").withColumn("log_price", log_of("avg_price_level"))
    columns = ["median_household_income", "avg_price_level", "avg_rating", "places_per_1000_people", "median_age"]
    return {"correlation": S.corr_matrix(areas, columns),
            "price_on_log_income": S.ols_summary(areas, "avg_price_level", "log_income", "zip5"),
            "log_price_on_log_income": S.ols_summary(priced, "log_price", "log_income", "zip5"),
            "scatter": charts.zip_scatter(areas, "zip5", SCATTER)}


def insights(spark: SparkSession, a) -> dict[str, DataFrame]:
    """``places`` is the table enriched by city."""
    df = tables.read_table(spark, a.places)
    served = load_serving(df)
    summary, leaders = P.price_page(df)
    return {"rating_by_city": A.mean_by(df, "city", "rating"), "price_by_city": A.count_by(df, ["price_level", "city"]),
            "top_types": E.top_types(df, "types", K.GENERIC_TYPES),
            "top_types_by_city": E.top_types_per_group(df, "city", "types", K.GENERIC_TYPES),
            "cuisines_by_city": E.top_split_types_per_group(df, "city", "types", K.GENERIC_TYPES_KEEP_STORE),
            "price_by_income": Q.mean_by_quantile(df.where("price_level > 0"), "median_household_income", "price_level"),
            "density": A.group_density(df, "census_name", "population_total", ["median_household_income"]),
            "rating_by_price": A.mean_by(df, "price_level", "rating", key_type="int"),
            "review_trend": S.trend_line(df, "rating", "user_ratings_total"), "price_summary": summary,
            "price_leaders": leaders, "kpis": A.kpis(served), "profile": A.null_profile(df),
            "top_places": TK.top_k(served, [("rating", -1), ("user_ratings_total", -1), "place_id"], 5)}


def clusters(spark: SparkSession, a) -> dict[str, DataFrame]:
    """``places`` is the table enriched by zip."""
    df = tables.read_table(spark, a.places).where("median_household_income > 0 and population_total > 1000")
    points = M.kmeans_points(df.select("place_id", "city", *K.CLUSTER_FEATURES), key="place_id").drop("place_id")
    return {"cluster_profile": A.profile_groups(points, "cluster", K.CLUSTER_FEATURES),
            "cluster_points": charts.cluster_points(points)}


def classify(spark: SparkSession, a) -> dict[str, DataFrame]:
    found = P.classify(tables.read_table(spark, a.places), model=a.model)
    return {name: df for name, df in found.items() if isinstance(df, DataFrame) and name != "train"}


JOBS: dict[str, tuple[Callable, list[str]]] = {
    "grid": (grid, []), "collect": (collect, ["pages"]), "collect-capped": (collect_capped, ["pages"]),
    "collect-stream": (collect_stream, ["pages", "log"]), "text-search": (text_search, ["pages"]), "backfill": (backfill, ["store", "details"]),
    "zips": (zips, ["places", "age", "income"]), "cities": (cities, ["places", "age", "income"]),
    "statistics": (statistics, ["zips"]), "insights": (insights, ["places"]),
    "clusters": (clusters, ["places"]), "classify": (classify, ["places"]),
}


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Runs one job and returns the names of the tables it wrote."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (_, needs) in JOBS.items():
        command = commands.add_parser(name)
        for need in [*needs, "out"]:
            command.add_argument(f"--{need}", required=True)
        if "pages" in needs:
            command.add_argument("--store")
        if name == "classify":
            command.add_argument("--model", choices=["forest", "logistic"], default="forest")
    args = parser.parse_args(argv)
    out = JOBS[args.job][0](apply_settings(spark), args)
    for name, df in out.items():
        tables.replace_table(df, f"{args.out.rstrip('/')}/{name}")
    return list(out)


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
