"""The tables behind the dashboard's pages, after load rules and filters."""

from placewise.plans import pipelines as P
from verification.catalog import query

FILTERS = dict(price_levels=[1, 2, 3], rating_range=(2.5, 4.5))
ROWS = "with r as (select * from serving where price_level in (1, 2, 3) and rating between 2.5 and 4.5 {more})"
ALL, ONE = ROWS.format(more=""), ROWS.format(more="and city = 'NATION_7'")
SHOWN = "place_id, name, city, rating, user_ratings_total, price_level"
KPIS = """ select count(*) places, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews,
             count(distinct city) cities from r"""
BEST = " select " + SHOWN + " from r order by rating desc, user_ratings_total desc, place_id limit {k}"
COUNTS = ' select {c}, count(*) "count" from r group by {c}'


def _overview(t):
    return P.overview_page(t.places, **FILTERS)


def _city(t, city):
    return P.city_page(t.places, city, **FILTERS)


@query(ALL + KPIS)
def overview_kpis(t):
    return _overview(t)["kpis"]


@query(ALL + COUNTS.format(c="rating"))
def overview_ratings(t):
    return _overview(t)["rating_counts"]


@query(ALL + COUNTS.format(c="price_level"))
def overview_prices(t):
    return _overview(t)["price_counts"]


@query(ALL + COUNTS.format(c="city"))
def overview_cities(t):
    return _overview(t)["city_counts"]


@query(ALL + BEST.format(k=5))
def overview_top_places(t):
    return _overview(t)["top_places"]


@query(ALL + """ select city, count(place_id) place_count, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews
         from r group by city""")
def city_comparison(t):
    return _city(t, "All")["city_summary"]


@query(ONE + KPIS)
def city_kpis(t):
    return _city(t, "NATION_7")["kpis"]


@query(ONE + COUNTS.format(c="rating"))
def city_ratings(t):
    return _city(t, "NATION_7")["rating_counts"]


@query(ONE + COUNTS.format(c="price_level"))
def city_prices(t):
    return _city(t, "NATION_7")["price_counts"]


@query(ONE + BEST.format(k=8))
def city_top_places(t):
    return _city(t, "NATION_7")["top_places"]


@query(ALL + f" select {SHOWN} from r")
def reviews_points(t):
    return P.rating_reviews_page(t.places, **FILTERS)["points"]


@query(ALL + f" select {SHOWN} from r order by user_ratings_total desc, place_id limit 8")
def reviews_most_reviewed(t):
    return P.rating_reviews_page(t.places, **FILTERS)["most_reviewed"]


@query(ALL + """, s as (select price_level, count(place_id) n, avg(rating) a, avg(user_ratings_total) v from r group by 1)
  select (select min(price_level) from s where n = (select max(n) from s)) top_place_count,
    (select min(price_level) from s where a = (select max(a) from s)) top_avg_rating,
    (select min(price_level) from s where v = (select max(v) from s)) top_avg_reviews""")
def insights_price_leaders(t):
    return P.insights_page(t.places, **FILTERS)["price_leaders"]


@query(ALL + """, s as (select city, count(place_id) n from r group by 1)
  select min(city) top_place_count from s where n = (select max(n) from s)""")
def insights_city_leader(t):
    return P.insights_page(t.places, **FILTERS)["city_leader"]
