"""Enrichment, area summaries, correlation and regression."""

from pyspark.sql import functions as F

from placewise.functions import before_comma, log_of, null_sentinels
from placewise.operators import aggregates as A, charts, joins as J, quantiles as Q, stats as S
from placewise.plans import pipelines as P
from verification.catalog import query, rounded

MEANS = {"rating": "avg_rating", "price_level": "avg_price_level"}
AREA_COLS = ["median_household_income", "avg_price_level", "avg_rating", "places_per_1000_people", "median_age"]
DEMO = P.DEMOGRAPHICS


def valid_zips(t):
    return charts.valid_areas(P.zip_analysis(t.places, t.zcta))


@query("select * from zip_analysis")
def area_summary(t):
    return P.zip_analysis(t.places, t.zcta)


@query("select * from zip_analysis")
def area_summary_of_enriched_rows(t):
    return A.area_summary(P.enriched_by_zip(t.places, t.zcta), "zip5", MEANS, DEMO, "population_total")


@query("select place_id, zip5, population_total, median_household_income, census_name from enriched_zip")
def enrich_zip(t):
    return P.enriched_by_zip(t.places, t.zcta).select(
        "place_id", "zip5", "population_total", "median_household_income", "census_name")


@query("select place_id, zip5, population_total, median_household_income, census_name from enriched_zip")
def enrich_zip_salted(t):
    return P.enriched_by_zip(t.places, t.zcta, salted=True).select(
        "place_id", "zip5", "population_total", "median_household_income", "census_name")


@query("""select o.o_orderkey, o.o_orderpriority, l.n_lines from orders o
          left join (select l_orderkey, count(*) n_lines from lineitem group by 1) l on o.o_orderkey = l.l_orderkey""")
def enrich_orders(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    dim = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    return J.enrich(t.orders.select("o_orderkey", "o_orderpriority"), dim, "o_orderkey")


@query("select * from enriched_city")
def enrich_city(t):
    fact = t.places.select("place_id", "city", "name", "rating", "user_ratings_total", "price_level",
                           "business_status", "types")
    return J.enrich(fact, t.city_demo, "city")


@query("select distinct city from places where city is not null and city not in (select city from city_demo)")
def unmapped_city(t):
    return J.unmapped(t.places, t.city_demo, "city")


@query("select zip5, population_total from zcta where zip5 in (select zip5 from places where length(zip5) = 5)")
def restrict_dim(t):
    return J.restrict_dim(t.zcta.select("zip5", "population_total"), t.places, "zip5")


@query("""select c.c_custkey, c.c_mktsegment, o.orders, o.total from customer c left join
          (select o_custkey, count(*) orders, round(sum(o_totalprice), 2) total from orders group by 1) o
          on c.c_custkey = o.o_custkey""")
def assemble_dim(t):
    right = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return J.assemble_dim(t.customer.select("c_custkey", "c_mktsegment"), right, "c_custkey")


PRIORITY_CODES = {"1-URGENT": {"state": "06", "place": "67000"}, "2-HIGH": {"state": "06", "place": "44000"},
                  "3-MEDIUM": {"state": "17", "place": "14000"}, "5-LOW": {"state": "17", "place": "14000"}}


@query("""with m(o_orderpriority, state, place) as (values ('1-URGENT', '06', '67000'), ('2-HIGH', '06', '44000'),
            ('3-MEDIUM', '17', '14000'), ('5-LOW', '17', '14000'))
          select o.o_orderkey, o.o_orderpriority, m.state, m.place
          from orders o join m on o.o_orderpriority = m.o_orderpriority""")
def lookup_codes(t):
    return J.lookup(t.orders.select("o_orderkey", "o_orderpriority"), PRIORITY_CODES, "o_orderpriority")


@query("""select distinct l_partkey from lineitem
          where l_partkey not in (select p_partkey from part where p_size > 25)""")
def unseen(t):
    batch = t.lineitem.select("l_partkey").distinct()
    store = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.unseen(batch, store, ["l_partkey"])


DENSITY = """select census_name, place_count, population_total, median_household_income,
      cast(place_count as double) / nullif(population_total, 0) * 1000.0 density_per_1000,
      split_part(census_name, ',', 1) label from (
    select census_name, count(*) place_count, avg(population_total) population_total,
      avg(median_household_income) median_household_income
    from enriched_city where population_total is not null and median_household_income is not null
      and census_name is not null group by census_name) g"""


@query(DENSITY)
def group_density(t):
    out = A.group_density_of(t.places, t.city_demo, "city", "census_name", "population_total",
                             ["median_household_income"])
    return out.withColumn("label", before_comma("census_name"))


@query(DENSITY)
def group_density_of_enriched_rows(t):
    out = A.group_density(J.enrich(t.places, t.city_demo, "city"), "census_name", "population_total",
                          ["median_household_income"])
    return out.withColumn("label", before_comma("census_name"))


@query("""select zip5, case when median_household_income > 0 then median_household_income end median_household_income,
          case when population_total > 0 then population_total end population_total from zcta""")
def null_sentinel_incomes(t):
    return null_sentinels(t.zcta, ["median_household_income", "population_total"]).select(
        "zip5", "median_household_income", "population_total")


PAIRS = [("median_household_income", "avg_price_level"), ("median_household_income", "avg_rating"),
         ("median_household_income", "places_per_1000_people"), ("median_age", "places_per_1000_people")]


@query(" union all ".join(
    f"""select zip5, '{x}' x_name, '{y}' y_name, cast({x} as double) x, cast({y} as double) y from valid_zips
        where {x} is not null and {y} is not null""" for x, y in PAIRS))
def zip_scatter(t):
    return charts.zip_scatter(valid_zips(t), "zip5", PAIRS)


@query(" union all ".join(f"select '{a}' x, '{b}' y, round(corr({a}, {b}), 6) r from valid_zips"
                          for a in AREA_COLS for b in AREA_COLS))
def corr_matrix(t):
    return rounded(S.corr_matrix(valid_zips(t), AREA_COLS))


@query(" union all ".join(f"select '{a}' x, '{b}' y, round(corr({a}, {b}), 6) r from lineitem"
                          for a in ["l_quantity", "l_extendedprice", "l_discount"]
                          for b in ["l_quantity", "l_extendedprice", "l_discount"]))
def corr_matrix_lines(t):
    return rounded(S.corr_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


OLS = """select round(regr_slope(y, x), 5) slope, round(regr_intercept(y, x), 5) intercept,
           round(regr_r2(y, x), 6) r2, cast(regr_count(y, x) as bigint) n from ({rows}) v"""


@query(OLS.format(rows="select avg_price_level y, ln(median_household_income) x from valid_zips"))
def ols_level_log(t):
    rows = valid_zips(t).withColumn("log_income", log_of("median_household_income"))
    return rounded(rounded(S.ols_simple(rows, "avg_price_level", "log_income"), 5, ["slope", "intercept"]), 6, ["r2"])


@query(OLS.format(rows="""select ln(avg_price_level) y, ln(median_household_income) x from valid_zips
                          where avg_price_level > 0"""))
def ols_log_log(t):
    rows = valid_zips(t).where("avg_price_level > 0").withColumns(
        {"log_income": log_of("median_household_income"), "log_price": log_of("avg_price_level")})
    return rounded(rounded(S.ols_simple(rows, "log_price", "log_income"), 5, ["slope", "intercept"]), 6, ["r2"])


# the logarithm of P(|T| > t) by Simpson's rule over log(u / t), added up below its largest term, and Student's t by its expansion around the normal point
TAIL = """(select ln(2 * max(w) / 3) + max(top) + ln(sum(share * exp(e - top))) from (select *, max(e) over () top from (
      select w, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end share, lgamma((v + 1) / 2)
        - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + {t} ** 2 * exp(2 * i * w) / v) + ln({t}) + i * w e
      from (select cast(n - 2 as double) v, greatest(50.0 / (n - 2),
            60.0 / (1 + {t} ** 2 * (n - 1) / (n - 2 + {t} ** 2))) / 4000 w) g, generate_series(0, 4000) s(i)) x) y)"""
CRITICAL = """(z + (z ** 3 + z) / (4 * (n - 2)) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * (n - 2.0) ** 2)
    + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * (n - 2.0) ** 3))"""
SUMMARY = """with v as ({rows}),
  f as (select count(*) n, regr_slope(y, x) slope, regr_intercept(y, x) intercept, regr_sxx(y, x) sxx,
          regr_syy(y, x) syy, avg(x) mean_x from v),
  e as (select k, y - f.intercept - f.slope * x e from v, f),
  l as (select e, e - lag(e) over (order by k) step from e),
  m as (select sum(e * e) rss, sum(step * step) dws, avg(e) mu from l),
  c as (select avg((e - mu) ** 2) m2, avg((e - mu) ** 3) m3, avg((e - mu) ** 4) m4 from e, m),
  s as (select *, rss / (n - 2) sigma2, sqrt(rss / (n - 2) / sxx) slope_se,
          sqrt(rss / (n - 2) * (1.0 / n + mean_x * mean_x / sxx)) intercept_se, m3 / m2 ** 1.5 skew, m4 / m2 ** 2 kurtosis,
          -n / 2 * (ln(2 * pi()) + ln(rss / n) + 1) loglik, cast(1.959963984540054 as double) z from f, m, c),
  u as (select *, slope / slope_se st, intercept / intercept_se it, abs(slope / slope_se) sa, abs(intercept / intercept_se) ia,
          n / 6 * (skew ** 2 + (kurtosis - 3) ** 2 / 4) jb, """ + CRITICAL + """ crit from s),
  p as (select *, """ + TAIL.format(t="sa") + " sp, " + TAIL.format(t="ia") + """ ip from u)
  select n, n - 2 dof, round(intercept, 4) intercept, round(slope, 4) slope, round(intercept_se, 4) intercept_se,
    round(slope_se, 4) slope_se, round(st, 4) slope_t, round(it, 4) intercept_t, round(sp, 4) slope_log_p,
    round(ip, 4) intercept_log_p, round(sp, 4) f_log_p, round(slope - crit * slope_se, 3) slope_lo,
    round(slope + crit * slope_se, 3) slope_hi, round(intercept - crit * intercept_se, 3) intercept_lo,
    round(intercept + crit * intercept_se, 3) intercept_hi, round(1 - rss / syy, 6) r2,
    round(1 - sigma2 / (syy / (n - 1)), 6) adj_r2, round(st ** 2, 4) f_stat,
    round(loglik, 4) loglik, round(4 - 2 * loglik, 4) aic, round(2 * ln(n) - 2 * loglik, 4) bic,
    round(skew, 5) skew, round(kurtosis, 5) kurtosis, round(jb, 4) jarque_bera, round(exp(-jb / 2), 9) jarque_bera_p,
    round(dws / rss, 6) durbin_watson from p"""
SUMMARY_DIGITS = {3: ["slope_lo", "slope_hi", "intercept_lo", "intercept_hi"],
                  4: ["intercept", "slope", "intercept_se", "slope_se", "slope_t", "intercept_t", "slope_log_p",
                      "intercept_log_p", "f_log_p", "f_stat", "loglik", "aic", "bic", "jarque_bera"],
                  5: ["skew", "kurtosis"], 6: ["r2", "adj_r2", "durbin_watson"], 9: ["jarque_bera_p"]}


def _summary(df):
    """All 26 columns; probabilities as logarithms, whose digits do not vanish in the tail."""
    for digits, cols in SUMMARY_DIGITS.items():
        df = rounded(df, digits, cols)
    return df.select("n", "dof", *[c for cols in SUMMARY_DIGITS.values() for c in cols])


@query(SUMMARY.format(rows="""select zip5 k, cast(avg_price_level as double) y, ln(median_household_income) x
                              from valid_zips where avg_price_level is not null"""))
def ols_summary(t):
    rows = valid_zips(t).withColumn("log_income", log_of("median_household_income"))
    return _summary(S.ols_summary(rows, "avg_price_level", "log_income", "zip5"))


@query(SUMMARY.format(rows="select o_orderkey k, o_totalprice / 1000 y, cast(o_custkey as double) x from orders"))
def ols_summary_orders(t):
    rows = t.orders.withColumn("total", F.col("o_totalprice") / 1000)
    return _summary(S.ols_summary(rows, "total", "o_custkey", "o_orderkey"))


BINS = """with v as ({rows}),
  e as (select list_sort(list_distinct(quantile_cont(cast(x as double),
          [cast(0 as double), cast(0.25 as double), cast(0.5 as double), cast(0.75 as double), cast(1 as double)]))) e from v),
  b as (select greatest(1, len(list_filter(e, lambda d: d < x))) b, m, e from v, e where len(e) > 1)
  select cast(b as int) bin_no, round(e[b], 4) bin_lo, round(e[b + 1], 4) bin_hi, count(*) "rows", round(avg(m), 6) {out}
  from b group by 1, 2, 3"""


def _bins(df):
    return rounded(rounded(df.drop("bin_label"), 4, ["bin_lo", "bin_hi"]), 6)


@query("""with v as (select l_orderkey, l_linenumber, cast(l_discount as double) x from lineitem),
  e as (select list_sort(list_distinct(quantile_cont(x, [cast(0 as double), cast(0.25 as double), cast(0.5 as double),
          cast(0.75 as double), cast(1 as double)]))) e from v),
  b as (select *, greatest(1, len(list_filter(e, lambda d: d < x))) b from v, e)
  select l_orderkey, l_linenumber, cast(b as int) bin_no,
    case when b = 1 then '[' else '(' end || cast(e[b] as varchar) || ', ' || cast(e[b + 1] as varchar) || ']' bin_label from b""")
def quantile_bins(t):
    return Q.quantile_bins(t.lineitem, "l_discount").select("l_orderkey", "l_linenumber", "bin_no", "bin_label")


@query(BINS.format(rows="select l_extendedprice x, l_quantity m from lineitem", out="avg_l_quantity"))
def mean_quantity_by_price_quantile(t):
    return _bins(Q.mean_by_quantile(t.lineitem, "l_extendedprice", "l_quantity"))


@query(BINS.format(rows="select l_discount x, l_quantity m from lineitem", out="avg_l_quantity"))
def mean_quantity_by_discount_quantile(t):
    return _bins(Q.mean_by_quantile(t.lineitem, "l_discount", "l_quantity"))


@query(BINS.format(rows="""select median_household_income x, price_level m from enriched_city
                           where median_household_income is not null and price_level > 0""", out="avg_price_level"))
def mean_price_by_income_quantile(t):
    rows = J.enrich(t.places, t.city_demo, "city").where("price_level > 0")
    return _bins(Q.mean_by_quantile(rows, "median_household_income", "price_level"))


@query("""with l as (select regr_slope(rating, ln(user_ratings_total)) b, regr_intercept(rating, ln(user_ratings_total)) a,
            cast(min(user_ratings_total) as double) lo, cast(max(user_ratings_total) as double) hi
            from places where rating is not null and user_ratings_total > 0),
          p as (select cast(i as int) i, lo + (hi - lo) * i / 99 x, a, b from l, generate_series(0, 99) g(i))
          select i, round(x, 6) x, round(a + b * ln(x), 6) y from p""")
def trend_line(t):
    return rounded(S.trend_line(t.places, "rating", "user_ratings_total"))


@query("""select place_id, round((rating - avg(rating) over ()) / stddev_pop(rating) over (), 6) rating_scaled,
            round((price_level - avg(price_level) over ()) / stddev_pop(price_level) over (), 6) price_level_scaled
          from places where rating is not null and price_level is not null""")
def standardize(t):
    rows = t.places.where("rating is not null and price_level is not null").select("place_id", "rating", "price_level")
    return rounded(S.standardize(rows, ["rating", "price_level"]).drop("rating", "price_level"))
