"""Place-like tables derived from the test tables: one SQL text that both Spark and DuckDB read.

``places`` has a row per order, ``zcta`` one per five-digit code derived from all parts, ``city_demo`` one
per nation that has a well-funded supplier. Ratings are in eighths, so that sums of them are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "labels"]

SQL = {
    "places": """
        select cast(o.o_orderkey as string) place_id, c.c_name name,
          case when o.o_orderkey % 37 = 0 then null else n.n_name end city,
          case when o.o_orderkey % 17 = 0 then null
               else 1 + ((o.o_orderkey * 7919) % 33) / cast(8 as double) end rating,
          case when o.o_orderkey % 7 = 0 then null
               else cast(substring(o.o_orderpriority, 1, 1) as int) - 1 end price_level,
          case when o.o_orderkey % 23 = 0 then null
               else cast(floor(o.o_totalprice / 100) as bigint) end user_ratings_total,
          case when o.o_orderstatus = 'F' then 'CLOSED_TEMPORARILY' else 'OPERATIONAL' end business_status,
          case when o.o_orderkey % 29 = 0 then '[' when o.o_orderkey % 31 = 0 then '[]'
               else concat('["restaurant","', lower(c.c_mktsegment), '_bar","',
                           lower(substring(o.o_orderpriority, 3)), '","food"]') end types,
          case when o.o_orderkey % 19 = 0 then null
               else lpad(cast(o.o_custkey % 100000 as string), 5, '0') end zip5
        from {orders} o
        join {customer} c on o.o_custkey = c.c_custkey
        join {nation} n on c.c_nationkey = n.n_nationkey""",
    "zcta": """
        select zip5, concat('ZCTA5 ', zip5) census_name,
          case when k % 13 = 0 then cast(0 as bigint) else cast(size_sum * 1000 as bigint) end population_total,
          cast(20 + size_max as double) median_age, size_max / cast(4 as double) pct_under_18,
          size_min / cast(8 as double) pct_65_plus,
          case when k % 11 = 0 then cast(-666666666 as bigint)
               else cast(round(price_max * 100) as bigint) end median_household_income
        from (select lpad(cast((p_partkey + 40) % 100000 as string), 5, '0') zip5, min(p_partkey) k,
                sum(p_size) size_sum, max(p_size) size_max, min(p_size) size_min, max(p_retailprice) price_max
              from {part} group by 1) z""",
    "city_demo": """
        select n.n_name city, concat(n.n_name, ', ', r.r_name) census_name,
          cast(count(c.c_custkey) * 1000 as bigint) population_total,
          cast(30 + n.n_nationkey as double) median_age, cast(15 + n.n_nationkey % 10 as double) pct_under_18,
          cast(10 + n.n_nationkey % 7 as double) pct_65_plus,
          cast(40000 + 1000 * n.n_nationkey as bigint) median_household_income,
          lpad(cast(n.n_regionkey as string), 2, '0') census_state_fips,
          lpad(cast(n.n_nationkey as string), 5, '0') census_place_fips
        from {nation} n
        join {region} r on n.n_regionkey = r.r_regionkey
        join {customer} c on c.c_nationkey = n.n_nationkey
        join (select distinct s_nationkey from {supplier} where s_acctbal > 5000) s
          on s.s_nationkey = n.n_nationkey
        group by n.n_name, r.r_name, n.n_nationkey, n.n_regionkey""",
}


class Tables:
    """The test tables and the stand-ins of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            used = {t: getattr(self, t) for t in BASE if "{" + t + "}" in SQL[name]}
            return self.spark.sql(SQL[name], **used)
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)


# SQL-side views; later ones build on earlier ones.
VIEWS = {
    **{name: text.format(**{t: t for t in BASE}) for name, text in SQL.items()},
    "enriched_zip": """
        select p.*, z.population_total, z.median_age, z.pct_under_18, z.pct_65_plus, z.median_household_income,
          z.census_name from places p left join zcta z on p.zip5 = z.zip5""",
    "zip_analysis": """
        select n.zip5, n.place_count, round(n.ratings / nullif(n.rated, 0), 3) avg_rating,
          round(cast(n.prices as double) / nullif(n.priced, 0), 3) avg_price_level, a.population_total, a.median_age,
          a.pct_under_18, a.pct_65_plus, a.median_household_income,
          case when a.population_total <> 0
               then round(1000.0 * (cast(n.place_count as double) / a.population_total), 3) end places_per_1000_people
        from (select zip5, count(*) place_count, sum(rating) ratings, count(rating) rated, sum(price_level) prices,
                count(price_level) priced from places group by zip5 having zip5 is not null) n
        left join (select zip5, max(population_total) population_total, max(median_age) median_age,
                     max(pct_under_18) pct_under_18, max(pct_65_plus) pct_65_plus,
                     max(median_household_income) median_household_income from zcta group by zip5) a on a.zip5 = n.zip5""",
    "valid_zips": """
        select * from zip_analysis where population_total is not null and median_household_income > 0""",
    "enriched_city": """
        select p.place_id, p.city, p.name, p.rating, p.user_ratings_total, p.price_level, p.business_status, p.types,
          d.census_name, d.population_total, d.median_age, d.pct_under_18, d.pct_65_plus, d.median_household_income,
          d.census_state_fips, d.census_place_fips
        from places p left join city_demo d on p.city = d.city""",
    "serving": """
        select place_id, name, coalesce(city, 'nan') city, rating, coalesce(price_level, 0) price_level,
          coalesce(user_ratings_total, 0) user_ratings_total, types from places where rating is not null""",
    "event_hits": """
        select event_type region, user_id, event_id,
          cast(epoch(date_trunc('hour', ts)) / 3600 as bigint)
            - (select cast(epoch(date_trunc('hour', min(ts))) / 3600 as bigint) from events) + 1 point_no
        from events""",
    "line_hits": """
        select l_returnflag region, l_partkey, l_orderkey,
          date_diff('day', (select cast(min(l_shipdate) as date) from lineitem), cast(l_shipdate as date)) + 1 point_no
        from lineitem""",
    "line_store": "select 'A' region, p_partkey l_partkey from part where p_size > 40",
    "scored_docs": """
        select d.doc_id, l.quality, n_chars / (n_chars + cast(4000 as double)) prob,
          case when n_chars >= 4000 then 1 else 0 end prediction
        from documents d join labels l on d.doc_id = l.doc_id""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views it uses, directly or through other views."""
    names, text = [], sql
    for name in reversed(list(VIEWS)):
        if _mentions(text, name):
            names.append(name)
            text += " " + VIEWS[name]
    if not names:
        return sql.strip()
    ctes = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in reversed(names))
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(from|join)\s+{name}\b", text) is not None
