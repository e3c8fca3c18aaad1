import datetime

from pyspark.sql import functions as F

from placewise import functions as X
from placewise.operators import explode as E, filters as P


def test_lenient_numbers(table):
    df = table("i int, s string", *enumerate(
        ["abc", " 5 ", "nan", "inf", "-3.9", "1e3", "", None, "7d", "0x10", "1.5f"]))
    got = [tuple(r) for r in df.orderBy("i").select(X.lenient_int("s"), X.lenient_double("s")).collect()]
    assert [g[0] for g in got] == [None, 5, None, None, -3, 1000, None, None, None, None, None]
    assert [g[1] for g in got] == [None, 5.0, None, float("inf"), -3.9, 1000.0, None, None, None, None, None]


def test_zip5_and_text(table):
    df = table("s string", ("94110-1234",), ("941",), (None,), ("01234",))
    assert [r[0] for r in df.select(X.zip5("s")).collect()] == ["94110", None, None, "01234"]
    one = table("a string, b string", ("", "second"), (None, None))
    assert [r[0] for r in one.select(X.first_non_empty("a", "b")).collect()] == ["second", None]
    row = table("n double, c string", (12345.987, "San Francisco city, California")).select(
        X.display_number("n"), X.display_number("n", 2), X.before_comma("c")).first()
    assert tuple(row) == ("12,345", "12345.99", "San Francisco city")


def test_density_has_no_division_error(table):
    df = table("n int, p int", (3, 0), (3, None), (3, 1500))
    assert [r[0] for r in df.select(X.per_thousand("n", "p")).collect()] == [None, None, 2.0]


def test_now_has_whole_seconds(spark):
    now = spark.range(1).select(X.utc_now_seconds().alias("t")).first()["t"]
    assert isinstance(now, datetime.datetime) and now.microsecond == 0


def test_first_tagged(table):
    df = table("c array<struct<long_name:string,types:array<string>>>",
               ([("x", ["route"]), ("94110", ["a", "postal_code"]), ("2", ["postal_code"])],),
               ([("x", ["route"])],), (None,))
    assert [r[0] for r in df.select(X.first_tagged("c", "postal_code")).collect()] == ["94110", None, None]


def test_explode_json(table, as_rows):
    df = table("i int, t string", (1, '["a","b"]'), (2, "bad"), (3, "[]"), (4, '{"a":1}'), (5, '["a"'), (6, "[1,null]"),
               (7, None))
    assert as_rows(E.explode_json_array(df, "t", "x"), "i", "x") == [(1, "a"), (1, "b"), (6, "1")]


def test_explode_delimited(table, as_rows):
    df = table("i int, t string", (1, '["Bar", "meal_takeaway"]'), (2, "[]"), (3, None))
    got = as_rows(E.explode_delimited(df, "t", "x"), "i", "x")
    assert got == [(1, "bar"), (1, "meal_takeaway"), (2, "")]


def test_filter_rules(table, as_rows):
    df = table("city string, price_level int, rating double, name string",
               ("A", 1, 4.0, "a.b"), ("B", 2, 3.0, "AxB"), ("B", None, 4.5, None))
    assert P.filter_places(df).count() == 3
    assert P.filter_places(df, price_levels=[]).count() == 3
    assert as_rows(P.filter_places(df, keyword="a.b"), "name") == [("AxB",), ("a.b",)]
    assert as_rows(P.filter_places(df, keyword="a.b", literal=True), "name") == [("a.b",)]
    assert as_rows(P.filter_places(df, rating_range=(3.0, 4.0)), "rating") == [(3.0,), (4.0,)]
    assert P.filter_places(df, city="B", price_levels=[2]).count() == 1


def test_serving_rules(table, as_rows):
    df = table("city string, price_level int, rating double, user_ratings_total bigint",
               (None, None, 4.0, None), ("A", 2, None, 5))
    assert as_rows(P.load_serving(df)) == [("nan", 0, 4.0, 0)]
    kept = P.load_serving(df, null_city_label=None)
    assert kept.where(F.col("city").isNull()).count() == 1
