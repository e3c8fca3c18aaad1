"""Filters, group summaries, top-k, explode, keyed writes, scalar functions, metrics, split."""

from pyspark.sql import functions as F

from placewise import constants as K, functions as X
from placewise.operators import (
    aggregates as A, cells, charts, explode as E, filters as P, keyed as W, metrics as M, quantiles as Q, split as SP,
    topk as TK,
)
from placewise.plans import pipelines
from placewise.session import shared_dir, stage
from placewise.sources import buckets
from verification.catalog import query, rounded

FILTERS = dict(city="NATION_3", price_levels=[1, 2, 3], rating_range=(2.5, 4.5), keyword="customer#0+[1-9]")


def serving(t):
    return P.load_serving(t.places)


# --- filters and projections

@query("select place_id, city, rating, price_level, user_ratings_total from serving")
def load_serving(t):
    return serving(t).select("place_id", "city", "rating", "price_level", "user_ratings_total")


@query("""select place_id, name, city, rating, price_level, user_ratings_total from serving
          where city = 'NATION_3' and price_level in (1, 2, 3) and rating between 2.5 and 4.5
            and regexp_matches(name, '(?i)customer#0+[1-9]')""")
def filter_places(t):
    return P.filter_places(serving(t), **FILTERS).select(
        "place_id", "name", "city", "rating", "price_level", "user_ratings_total")


@query("""select 'city' "domain", city text_value, cast(null as double) number_value from serving group by city
          union all select 'price_level', null, price_level from serving group by price_level
          union all select 'min_rating', null, min(rating) from serving
          union all select 'max_rating', null, max(rating) from serving""")
def filter_domains(t):
    return P.filter_domains(serving(t))


@query("select place_id, city, rating from places where city is not null and rating is not null")
def drop_incomplete(t):
    return P.drop_incomplete(t.places.select("place_id", "city", "rating"), ["city", "rating"])


@query("select distinct zip5 from places where length(zip5) = 5")
def distinct_zips(t):
    return P.distinct_values(P.exact_length(t.places, "zip5", 5), "zip5")


@query("""select place_id, rating, case when rating >= 4.6 then 1 else 0 end high_rated from places
          where rating is not null""")
def binary_target(t):
    return P.binary_target(t.places.select("place_id", "rating"), "rating", K.HIGH_RATING, "high_rated")


@query("""select p_partkey id, p_name title, p_size size from part
          where p_type is not null and p_type not in ('ECONOMY', 'PROMO') and p_retailprice > 950""")
def rename_and_exclude(t):
    rows = P.exclude_values(t.part, "p_type", ["ECONOMY", "PROMO"]).where(F.col("p_retailprice") > 950)
    return P.rename(rows.select("p_partkey", "p_name", "p_size"),
                    {"p_partkey": "id", "p_name": "title", "p_size": "size"})


@query("select city, user_ratings_total, rating from places where rating is not null and user_ratings_total > 0")
def rating_review_points(t):
    return charts.rating_review_points(t.places)


# --- group summaries

@query("select city, avg(rating) avg_rating from places where city is not null and rating is not null group by city")
def mean_rating_by_city(t):
    return A.mean_by(t.places, "city", "rating")


@query("""select cast(price_level as int) price_level, avg(rating) avg_rating from places
          where price_level is not null and rating is not null group by 1""")
def mean_rating_by_price(t):
    return A.mean_by(t.places, "price_level", "rating", key_type="int")


@query("""select price_level, city, count(*) "count" from places
          where price_level is not null and city is not null group by 1, 2""")
def price_counts_by_city(t):
    return A.count_by(t.places, ["price_level", "city"])


SEGMENT = """select {k}, count(place_id) place_count, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews
             from serving group by {k}"""


@query(SEGMENT.format(k="city"))
def segment_summary_city(t):
    return A.segment_summary(serving(t), "city")


@query(SEGMENT.format(k="price_level"))
def segment_summary_price(t):
    return pipelines.price_page(t.places)[0]


@query(f"""with s as ({SEGMENT.format(k="price_level")})
           select (select min(price_level) from s where place_count = (select max(place_count) from s)) top_place_count,
             (select min(price_level) from s where avg_rating = (select max(avg_rating) from s)) top_avg_rating,
             (select min(price_level) from s where avg_reviews = (select max(avg_reviews) from s)) top_avg_reviews""")
def argmax_segments(t):
    return pipelines.price_page(t.places)[1]


@query(f"""with s as ({SEGMENT.format(k="city")})
           select min(city) top_place_count from s where place_count = (select max(place_count) from s)""")
def argmax_city(t):
    return A.argmax_by(A.segment_summary(serving(t), "city"), "city", ["place_count"])


@query("""select count(*) places, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews,
            count(distinct city) cities from serving""")
def kpis(t):
    return A.kpis(serving(t))


@query("""select count(*) places, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews,
            count(distinct city) cities from serving
          where price_level in (1, 2, 3) and rating between 2.5 and 4.5""")
def kpis_filtered(t):
    return A.kpis(P.filter_places(serving(t), price_levels=[1, 2, 3], rating_range=(2.5, 4.5)))


@query("""select count(*) places, avg(rating) avg_rating, avg(user_ratings_total) avg_reviews,
            count(distinct city) cities from serving
          where price_level in (1, 2, 3) and rating between 2.5 and 4.5""")
def kpis_from_cells(t):
    """The filter meets staged cells, not the places."""
    cut = cells.cell_sums(serving(t), ["city", "price_level", "rating"], ["rating", "user_ratings_total"])
    return cells.kpis_of_cells(P.filter_places(stage(cut, "cells"), price_levels=[1, 2, 3], rating_range=(2.5, 4.5)))


@query("""select l_returnflag, count(distinct l_partkey) distinct_count from lineitem
          where l_linestatus = 'F' and l_linenumber in (2, 3) group by 1""")
def distinct_parts_from_cells(t):
    """Distinct parts per flag for one filter, from staged bitmaps of all cells."""
    cut = cells.cell_bitmaps(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_partkey")
    cut = stage(cut, "cells").where("l_linestatus = 'F' and l_linenumber in (2, 3)")
    return cells.distinct_of_cells(cut, ["l_returnflag"])


@query("""select rating, count(*) "count" from serving group by rating""")
def rating_counts(t):
    return A.value_counts(serving(t), "rating", sort="value")


@query("""select city, count(*) "count" from places where city is not null group by city
          order by 2 desc, 1 limit 10""")
def city_counts(t):
    return A.value_counts(t.places, "city", k=10)


@query("""select price_level, count(*) "count" from places group by price_level""")
def price_counts_with_nulls(t):
    return A.value_counts(t.places, "price_level", dropna=False, k=10)


@query("select count(distinct l_partkey) distinct_count from lineitem")
def distinct_parts(t):
    return A.distinct_count(t.lineitem, "l_partkey")


@query("""select l_returnflag, count(*) size, round(avg(l_quantity), 6) avg_l_quantity,
            round(avg(l_extendedprice), 6) avg_l_extendedprice from lineitem group by 1""")
def profile_groups(t):
    return rounded(A.profile_groups(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"]))


PLACE_COLUMNS = ["place_id", "name", "city", "rating", "price_level", "user_ratings_total", "business_status", "types",
                 "zip5"]


@query(" union all ".join(
    f"""select '{c}' column_name, count(*) - count({c}) null_count, count(*) row_count, 9 column_count from places"""
    for c in PLACE_COLUMNS))
def null_profile(t):
    return A.null_profile(t.places)


DESCRIBE = """select '{c}' column_name, count({c}) "count", round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std,
  round(cast(min({c}) as double), 4) "min", round(quantile_cont(cast({c} as double), cast(0.25 as double)), 4) p25,
  round(quantile_cont(cast({c} as double), cast(0.5 as double)), 4) p50,
  round(quantile_cont(cast({c} as double), cast(0.75 as double)), 4) p75, round(cast(max({c}) as double), 4) "max"
  from {t}"""


@query(" union all ".join(DESCRIBE.format(c=c, t="lineitem")
                          for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def describe_lines(t):
    return rounded(Q.describe_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


@query(" union all ".join(DESCRIBE.format(c=c, t="places") for c in ["rating", "price_level", "user_ratings_total"]))
def describe_places(t):
    return rounded(Q.describe_numeric(t.places, ["rating", "price_level", "user_ratings_total"]), 4)


# --- top-k and samples

JSON_TAGS = """select city, unnest(case when json_valid(types) and json_type(types) = 'ARRAY'
  then from_json(types, '["VARCHAR"]') end) "type" from places"""
SPLIT_TAGS = """select city, replace(tag, '_', ' ') "type" from (
  select city, lower(trim(unnest(string_split(regexp_replace(types, '[\\[\\]''"]', '', 'g'), ',')))) tag
  from places where types is not null) x
  where tag not in ('restaurant', 'food', 'establishment', 'point_of_interest')"""
NOT_GENERIC = """"type" is not null
  and "type" not in ('restaurant', 'food', 'point_of_interest', 'establishment', 'store')"""


@query(f"""select "type", count(*) "count" from ({JSON_TAGS}) x where {NOT_GENERIC}
           group by 1 order by 2 desc, 1 limit 10""")
def types_top10(t):
    return E.top_types(t.places, "types", K.GENERIC_TYPES)


TOP5 = """select city, "type", "count" from (
  select *, row_number() over (partition by city order by "count" desc, "type") rn from (
    select city, "type", count(*) "count" from ({tags}) x where city is not null and {cond} group by 1, 2) y) z
  where rn <= 5"""


@query(TOP5.format(tags=JSON_TAGS, cond=NOT_GENERIC))
def types_top5_city(t):
    return E.top_types_per_group(t.places, "city", "types", K.GENERIC_TYPES)


@query(TOP5.format(tags=SPLIT_TAGS, cond="true"))
def types_split_top5_city(t):
    return E.top_split_types_per_group(t.places, "city", "types", K.GENERIC_TYPES_KEEP_STORE)


@query("""select place_id, name, city, rating, user_ratings_total, price_level from serving
          order by rating desc, user_ratings_total desc, place_id limit 5""")
def top_places(t):
    return TK.top_k(serving(t), [("rating", -1), ("user_ratings_total", -1), "place_id"], 5).select(
        "place_id", "name", "city", "rating", "user_ratings_total", "price_level")


@query("""select place_id, name, rating, user_ratings_total, price_level from serving where city = 'NATION_7'
          order by rating desc, user_ratings_total desc, place_id limit 8""")
def top_places_of_city(t):
    rows = P.filter_places(serving(t), city="NATION_7")
    return TK.top_k(rows, [("rating", -1), ("user_ratings_total", -1), "place_id"], 8).select(
        "place_id", "name", "rating", "user_ratings_total", "price_level")


@query("""select place_id, name, city, rating, user_ratings_total from serving
          order by user_ratings_total desc, place_id limit 8""")
def most_reviewed(t):
    return TK.top_k(serving(t), [("user_ratings_total", -1), "place_id"], 8).select(
        "place_id", "name", "city", "rating", "user_ratings_total")


@query("select c_custkey, c_name, c_mktsegment from customer order by c_mktsegment, c_custkey desc")
def sort_mixed(t):
    return TK.sort_by(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_mktsegment", ("c_custkey", -1)])


@query("select place_id, city, census_name from enriched_city order by place_id limit 5")
def preview(t):
    rows = t.places.join(t.city_demo.select("city", "census_name"), "city", "left")
    return TK.preview(rows.select("place_id", "city", "census_name"), ["place_id"])


@query("""select o_orderkey, o_totalprice from orders
          order by md5(concat('1', cast(o_orderkey as string))), o_orderkey limit 1000""")
def sample_n(t):
    return TK.sample_n(t.orders.select("o_orderkey", "o_totalprice"), 1000, "o_orderkey", seed=1)


# --- keyed writes

KEYS = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
LAST = ", ".join(f"{c} desc" for c in ORDER)
FIRST = ", ".join(ORDER)
LINES = "select *, row_number() over (partition by l_orderkey, l_linenumber order by {order}) rn from lineitem where l_linestatus = '{status}'"
SHOW = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]


def _store(t):
    return W.latest_per_key(t.lineitem.where("l_linestatus = 'O'"), KEYS, ORDER)


def _batch(t):
    rows = t.lineitem.where("l_linestatus = 'F'")
    return rows.withColumn("l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")))


UPSERT = f"""with a as (select *, true had from ({LINES.format(order=LAST, status='O')}) x where rn = 1),
  b as (select *, true hit from ({LINES.format(order=LAST, status='F').replace(
      'select *,', 'select * replace (case when l_discount > 0 then l_extendedprice end as l_extendedprice),')}) x where rn = 1)
  select coalesce(a.l_orderkey, b.l_orderkey) l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) l_linenumber,
    case when a.had then a.l_partkey else b.l_partkey end l_partkey, case when b.hit then b.l_quantity else a.l_quantity end l_quantity,
    case when b.hit then b.l_extendedprice else a.l_extendedprice end l_extendedprice,
    case when a.had then a.l_discount else b.l_discount end l_discount,
    case when b.hit then 'touched' else a.l_linestatus end l_linestatus
  from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber"""


def _upsert(t, small):
    # the batch's own price is nulled after its rows were ordered by the price as landed
    batch = W.latest_per_key(t.lineitem.where("l_linestatus = 'F'"), KEYS, ORDER)
    batch = batch.withColumn("l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")))
    return W.upsert(_store(t), batch, KEYS, ["l_quantity", "l_extendedprice"], ORDER,
                    touch={"l_linestatus": F.lit("touched")}, small_batch=small).select(*SHOW)


@query(UPSERT)
def upsert_lines(t):
    return _upsert(t, False)


@query(UPSERT)
def upsert_lines_small_batch(t):
    return _upsert(t, True)


@query(UPSERT)
def upsert_lines_buckets(t):
    """The store in buckets of its key; the batch rewrites the buckets that it touches."""
    batch = W.latest_per_key(t.lineitem.where("l_linestatus = 'F'"), KEYS, ORDER)
    batch = batch.withColumn("l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")))
    path = shared_dir(t.spark, "buckets")
    name = "store_" + path.rsplit("-", 1)[1]
    buckets.create_buckets(_store(t), name, path, KEYS, 32)
    buckets.upsert_buckets(t.spark, name, path, batch, KEYS, 32, ["l_quantity", "l_extendedprice"], ORDER,
                           touch={"l_linestatus": F.lit("touched")})
    return buckets.read_buckets(t.spark, name).select(*SHOW)


@query(f"""with a as (select * from ({LINES.format(order=LAST, status='O')}) x where rn = 1),
  b as (select * from ({LINES.format(order=FIRST, status='F')}) x where rn = 1)
  select {', '.join(SHOW)} from a union all
  select {', '.join(SHOW)} from b where not exists (
    select 1 from a where a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber)""")
def insert_new_lines(t):
    return W.insert_new(_store(t), t.lineitem.where("l_linestatus = 'F'"), KEYS, ORDER).select(*SHOW)


DETAILS = """select cast(l_orderkey as string) place_id, case when l_returnflag = 'R' then 'NOT_FOUND' else 'OK' end status,
  case when l_linestatus = 'O' then lpad(cast(l_suppkey as string), 5, '0') end zip5,
  concat('Supplier ', cast(l_suppkey as string)) name,
  row_number() over (partition by l_orderkey order by l_linenumber desc, l_shipdate desc, l_partkey desc, l_suppkey desc,
    l_quantity desc, l_extendedprice desc) rn from lineitem"""
DETAIL_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _details(t):
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("place_id"),
        F.when(F.col("l_returnflag") == "R", "NOT_FOUND").otherwise("OK").alias("status"),
        F.when(F.col("l_linestatus") == "O", F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("zip5"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("name"), *DETAIL_ORDER)


@query(f"""with d as (select * from ({DETAILS}) x where rn = 1 and status = 'OK')
  select p.place_id, case when p.zip5 is null and d.status is not null then d.zip5 else p.zip5 end zip5,
    case when p.zip5 is null and d.status is not null then d.name else p.name end name, p.city
  from places p left join d on p.place_id = d.place_id""")
def backfill(t):
    target = t.places.select("place_id", "zip5", "name", "city")
    return W.backfill(target, _details(t), ["place_id"], "zip5", ["zip5", "name"], DETAIL_ORDER)


@query(f"""with d as (select * from ({DETAILS}) x where rn = 1)
  select count(*) total, count(*) filter (where d.status = 'OK') updated,
    count(*) filter (where d.status not in ('OK', 'OVER_QUERY_LIMIT')) skipped
  from places p left join d on p.place_id = d.place_id where p.zip5 is null""")
def backfill_stats(t):
    return W.backfill_stats(t.places, _details(t), ["place_id"], "zip5", DETAIL_ORDER)


# --- scalar functions

@query("""select event_id, cast(trunc(try_cast(k as double)) as bigint) k_int, try_cast(k as double) k_double
          from (select event_id, case when event_id % 11 = 0 then 'abc' when event_id % 13 = 0 then ' -3.9 '
                  when event_id % 17 = 0 then 'nan' when event_id % 19 = 0 then '' when event_id % 23 = 0 then '1e3'
                  else json_extract_string(props, '$.k') end k from events) x
          where k <> 'nan' union all
          select event_id, null, null from events where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 = 0""")
def lenient_casts(t):
    e = F.col("event_id")
    text = (F.when(e % 11 == 0, "abc").when(e % 13 == 0, " -3.9 ").when(e % 17 == 0, "nan").when(e % 19 == 0, "")
            .when(e % 23 == 0, "1e3").otherwise(F.get_json_object("props", "$.k")))
    return t.events.select("event_id", X.lenient_int(text).alias("k_int"), X.lenient_double(text).alias("k_double"))


@query("""select p_partkey, nullif(regexp_extract(code, '^(\\d{5})', 1), '') zip5,
            split_part(label, ',', 1) before, coalesce(nullif(a, ''), nullif(p_name, '')) first_text,
            round(p_retailprice / 7, 3) rounded, replace(concat(p_type, '_', p_brand), '_', ' ') pretty,
            round(ln(p_retailprice), 9) log_price, round(ln(1 + p_size), 9) log1p_size,
            format('{:,}', cast(trunc(p_retailprice * 1234.5) as bigint)) shown, coalesce(a, 'none') filled,
            concat('["', p_type, '","', p_brand, '"]') json
          from (select *, concat(lpad(cast(p_partkey as string), case when p_partkey % 5 = 0 then 4 else 5 end, '0'), '-12') code,
                  concat(p_name, ', ', p_brand) label,
                  case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then p_brand end a from part) x""")
def scalar_functions(t):
    k = F.col("p_partkey")
    code = F.concat(F.when(k % 5 == 0, F.lpad(k.cast("string"), 4, "0")).otherwise(F.lpad(k.cast("string"), 5, "0")),
                    F.lit("-12"))
    a = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_brand"))
    return t.part.select(
        "p_partkey", X.zip5(code).alias("zip5"),
        X.before_comma(F.concat("p_name", F.lit(", "), "p_brand")).alias("before"),
        X.first_non_empty(a, "p_name").alias("first_text"), X.round_to(F.col("p_retailprice") / 7).alias("rounded"),
        X.prettify(F.concat("p_type", F.lit("_"), "p_brand")).alias("pretty"),
        F.round(X.log_of("p_retailprice"), 9).alias("log_price"), F.round(X.log1p_of("p_size"), 9).alias("log1p_size"),
        X.display_number(F.col("p_retailprice") * 1234.5).alias("shown"), X.fill(a, "none").alias("filled"),
        X.to_json_text(F.array("p_type", "p_brand")).alias("json"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
            case when l_returnflag = 'A' then concat('9', cast(l_partkey as string))
                 when l_linestatus = 'O' then cast(l_suppkey as string) end postal_code from lineitem""")
def first_tagged_component(t):
    def part(value, *tags):
        return F.struct(value.alias("long_name"), F.array(*[F.lit(x) for x in tags]).alias("types"))

    supp = F.col("l_suppkey").cast("string")
    tagged = F.concat(F.lit("9"), F.col("l_partkey").cast("string"))
    parts = F.when(F.col("l_returnflag") == "A", F.array(
        part(F.lit("x"), "locality"), part(tagged, "x", "postal_code"), part(supp, "postal_code")))
    parts = parts.when(F.col("l_linestatus") == "O", F.array(part(supp, "postal_code")))
    parts = parts.when(F.col("l_returnflag") == "N", F.array(part(supp, "route")))
    rows = t.lineitem.withColumn("components", parts)
    return rows.select(*KEYS, "l_partkey", "l_suppkey", X.first_tagged("components", "postal_code").alias("postal_code"))


# --- metrics and split

def scored(t):
    docs = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id")
    return docs.select("doc_id", "quality", (F.col("n_chars") / (F.col("n_chars") + F.lit(4000.0))).alias("prob"),
                       F.when(F.col("n_chars") >= 4000, 1).otherwise(0).alias("prediction"))


SWEEP = """select threshold, cast(count(*) filter (where (prob >= threshold) = (quality = 1)) as double) / count(*) accuracy,
    coalesce(cast(count(*) filter (where prob >= threshold and quality = 1) as double)
      / nullif(count(*) filter (where prob >= threshold), 0), 0) "precision",
    coalesce(cast(count(*) filter (where prob >= threshold and quality = 1) as double)
      / nullif(count(*) filter (where quality = 1), 0), 0) recall
  from scored_docs, (select cast(unnest([0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]) as double) threshold) t
  group by threshold"""


@query(SWEEP)
def threshold_sweep(t):
    return M.threshold_sweep(scored(t), "quality", "prob")


@query(f"""with s as ({SWEEP})
  select * from s order by (recall >= 0.55) desc,
    case when recall >= 0.55 then "precision" else 2 * "precision" * recall / ("precision" + recall + 1e-9) end desc,
    threshold limit 1""")
def pick_threshold(t):
    return M.pick_threshold(M.threshold_sweep(scored(t), "quality", "prob"))


@query("""select a.v actual, p.v predicted, count(s.doc_id) "rows"
  from (values (0), (1)) a(v) cross join (values (0), (1)) p(v)
  left join scored_docs s on s.quality = a.v and s.prediction = p.v group by 1, 2""")
def confusion(t):
    return M.confusion(scored(t), "quality", "prediction")


CLASS_ROWS = """with c as (select v, (select count(*) from scored_docs where quality = v) support,
      (select count(*) from scored_docs where prediction = v) predicted,
      (select count(*) from scored_docs where prediction = v and quality = v) tp from (values (0), (1)) x(v)),
    r as (select cast(v as string) "class", coalesce(cast(tp as double) / nullif(predicted, 0), 0) "precision",
      coalesce(cast(tp as double) / nullif(support, 0), 0) recall, support, tp from c),
    f as (select *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) f1 from r)"""


@query(f"""{CLASS_ROWS}
  select "class", round("precision", 9) "precision", round(recall, 9) recall, round(f1, 9) f1, support from f
  union all select 'accuracy', null, null, round(cast(sum(tp) as double) / sum(support), 9), cast(sum(support) as bigint) from f
  union all select 'macro avg', round(avg("precision"), 9), round(avg(recall), 9), round(avg(f1), 9), cast(sum(support) as bigint) from f
  union all select 'weighted avg', round(sum("precision" * support) / sum(support), 9),
    round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from f""")
def class_report(t):
    return rounded(M.class_report(scored(t), "quality", "prediction"), 9)


@query(f"""{CLASS_ROWS}
  select cast(sum(tp) as double) / sum(support) accuracy, max("precision") filter (where "class" = '1') "precision",
    max(recall) filter (where "class" = '1') recall from f""")
def binary_metrics(t):
    return M.binary_metrics(scored(t), "quality", "prediction")


SPLIT = """with r as (select {key}, {label}, row_number() over (partition by {label}
      order by md5(concat('42', cast({key} as string))), {key}) rn from ({rows}) v),
    n as (select {label}, count(*) c, sum(count(*)) over () n, ceil(cast(sum(count(*)) over () as double) * 0.2) size from r group by 1),
    b as (select *, floor(c * size / n) base, c * size - floor(c * size / n) * n remainder from n),
    q as (select {label}, base + case when row_number() over (order by remainder desc, {label})
      <= size - sum(base) over () then 1 else 0 end quota from b)
  select r.{key}, r.{label}, case when rn <= quota then 'test' else 'train' end part
  from r join q on r.{label} = q.{label}"""


@query(SPLIT.format(key="doc_id", label="quality", rows="select doc_id, quality from labels"))
def stratified_split(t):
    return SP.stratified_split(t.labels.select("doc_id", "quality"), "quality", "doc_id")


@query(SPLIT.format(key="o_orderkey", label="o_orderpriority", rows="select * from orders"))
def stratified_split_orders(t):
    return SP.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("""select doc_id, quality, cast(count(*) over () as double)
    / ((select count(distinct quality) from labels) * count(*) over (partition by quality)) weight from labels""")
def balanced_weights(t):
    return SP.balanced_weights(t.labels.select("doc_id", "quality"), "quality")
