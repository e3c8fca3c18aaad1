"""Landed search pages and place details (JSON lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placewise.constants import MAX_PAGES
from placewise.functions import first_non_empty, first_tagged, to_json_text
from placewise.operators.keyed import latest_per_key
from placewise.schemas import PLACE_DETAIL, PLACE_PAYLOAD, SEARCH_PAGE

GOOD = ["OK", "ZERO_RESULTS"]


def read_search_pages(spark: SparkSession, path: str, max_pages: int = MAX_PAGES,
                      on_error: str = "drop_point") -> DataFrame:
    """One row per result: city, point, page, ``pos`` in the page, ``place_json`` text, ``place`` struct.

    A line is one attempt at one page: city, point_no, page_no, attempt, payload. A later attempt replaces an
    earlier one. A point with any page whose last status is neither ``OK`` nor ``ZERO_RESULTS`` gives no rows
    (``drop_point``) or fails the query (``fail``). So does a point with a line that is not JSON, as far as the line
    still names its point.
    """
    if on_error not in ("drop_point", "fail"):
        raise ValueError("on_error is 'drop_point' or 'fail'")
    return search_results(read_page_lines(spark, path), max_pages, on_error)


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed lines as they are; ``_corrupt`` holds the text of a line that is not JSON."""
    return (
        spark.read.schema(SEARCH_PAGE + ", _corrupt string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """The lines that are not JSON, with what can be read of the point they belong to, which ``drop_point`` drops."""
    return _with_point(lines).where("_unreadable").select("city", "point_no", F.col("_corrupt").alias("line"))


def _with_point(lines: DataFrame) -> DataFrame:
    """``_unreadable`` per line; the point of an unreadable one is looked for in its text."""
    if "_corrupt" not in lines.columns:
        return lines.withColumn("_unreadable", F.lit(False))
    city = F.coalesce("city", F.nullif(F.regexp_extract("_corrupt", r'"city"\s*:\s*"([^"]*)"', 1), F.lit("")))
    point = F.coalesce("point_no", F.expr(r"try_cast(regexp_extract(_corrupt, '\"point_no\"\\s*:\\s*([0-9]+)', 1) as bigint)"))
    return lines.withColumns({"city": city, "point_no": point, "_unreadable": F.col("_corrupt").isNotNull()})


def last_attempts(lines: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The last attempt at each page, with two facts about its point: ``_failed`` (a page is bad or unreadable) and
    ``_whole`` (none is, and pages 1 to the one without a next page, or to ``max_pages``, are there).

    One shuffle serves all windows; a point has few pages and attempts, so its group is small.
    """
    lines = _with_point(lines).where(F.col("city").isNotNull() & F.col("point_no").isNotNull())
    attempts = lines.where((F.col("page_no") <= max_pages) | F.col("_unreadable")).repartition("city", "point_no")
    attempts = attempts.withColumn("page_no", F.when(~F.col("_unreadable"), F.col("page_no")))
    pages = latest_per_key(attempts, ["city", "point_no", "page_no"], ["attempt"])
    point = Window.partitionBy("city", "point_no")
    bad = F.col("_unreadable") | ~F.coalesce(F.col("payload.status").isin(GOOD), F.lit(False))
    ends = F.col("payload.next_page_token").isNull() | (F.col("page_no") >= max_pages)
    pages = pages.withColumns({"_failed": F.max(bad).over(point), "_top": F.max("page_no").over(point),
                               "_pages": F.count("*").over(point), "_ends": F.max_by(ends, "page_no").over(point)})
    whole = ~F.col("_failed") & (F.col("_top") == F.col("_pages")) & F.col("_ends")
    return pages.withColumn("_whole", F.coalesce(whole, F.lit(False))).drop("_top", "_pages", "_ends")


def search_results(lines: DataFrame, max_pages: int = MAX_PAGES, on_error: str = "drop_point") -> DataFrame:
    if on_error == "fail" and "_corrupt" in lines.columns:
        lines = lines.where(_fail_if(F.col("_corrupt").isNotNull(), "a page file holds a line that is not JSON"))
    pages = last_attempts(lines, max_pages)
    pages = pages.where(_fail_if(F.col("_failed"), "a search point failed") if on_error == "fail" else ~F.col("_failed"))
    results = pages.select("city", "point_no", "page_no", F.posexplode("payload.results").alias("pos", "place_json"))
    return results.withColumn("place", F.from_json("place_json", PLACE_PAYLOAD))


def _fail_if(bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def flatten_places(df: DataFrame, address_order=("vicinity", "formatted_address"),
                   extra: list[str] | None = None) -> DataFrame:
    """Place structs to the flat store columns; the address is the first non-empty one of ``address_order``."""
    p = "place."
    return df.select(
        "city", F.col(p + "place_id"), F.col(p + "name"),
        first_non_empty(*[p + a for a in address_order]).alias("formatted_address"),
        F.col(p + "geometry.location.lat").alias("lat"), F.col(p + "geometry.location.lng").alias("lng"),
        F.col(p + "rating"), F.col(p + "user_ratings_total"), F.col(p + "price_level"), F.col(p + "business_status"),
        to_json_text(F.coalesce(F.col(p + "types"), F.array().cast("array<string>"))).alias("types"),
        F.col("place_json").alias("raw_json"), *(extra or []))


def read_place_details(spark: SparkSession, path: str, extra: str = "attempt int") -> DataFrame:
    """Landed detail answers, flattened: city, place_id, attempt, status, postal_code, formatted_address."""
    df = spark.read.schema(f"{PLACE_DETAIL}, {extra}").json(path)
    return df.select("city", "place_id", "attempt", "status",
                     first_tagged("result.address_components", "postal_code").alias("postal_code"),
                     F.col("result.formatted_address").alias("formatted_address"))
