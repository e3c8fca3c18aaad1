"""Landed files and sinks: each query writes files derived from the tables and reads them back."""

from pyspark.sql import Window, functions as F

from placewise import constants as K, functions as X
from placewise.operators import joins as J, keyed as W
from placewise.plans import pipelines as P
from placewise.schemas import ENRICHED_PLACES, PLACES
from placewise.session import shared_dir
from placewise.sources import pages, tables
from placewise.streaming import ingest, points
from verification.catalog import query

PAGE, POINT = 20, 60


def landed_pages(t) -> str:
    """Search pages made of events: 60 results per point, 20 per page; some attempts and some points fail."""
    path = shared_dir(t.spark, "pages")
    tables.write_json(page_lines(t), path)
    return path


def page_lines(t):
    e = t.events
    point = F.floor(F.col("event_id") / POINT)
    in_point = F.col("event_id") % POINT
    place = F.struct(
        F.col("user_id").cast("string").alias("place_id"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit("near "), "event_type"))
        .alias("vicinity"),
        F.concat(F.col("event_id").cast("string"), F.lit(" Main St")).alias("formatted_address"),
        F.struct(F.struct((F.col("event_id") % 90).cast("double").alias("lat"),
                          (F.col("event_id") % 180 - 180).cast("double").alias("lng")).alias("location")).alias("geometry"),
        (1 + (F.col("event_id") % 33) / 8).alias("rating"), F.col("user_id").alias("user_ratings_total"),
        (F.col("event_id") % 5).cast("int").alias("price_level"), F.lit("OPERATIONAL").alias("business_status"),
        F.when(F.col("event_id") % 10 != 0, F.array("event_type", F.lit("food"))).alias("types"),
        F.col("props").alias("unknown_field"))
    found = e.select(point.alias("point_no"), (F.floor(in_point / PAGE) + 1).cast("int").alias("page_no"),
                     (F.col("event_id") % PAGE).alias("pos"), place.alias("place"))
    good = found.groupBy("point_no", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("r")).select(
        "point_no", "page_no", F.transform("r", lambda x: x["place"]).alias("results"))
    last_page = F.max("page_no").over(Window.partitionBy("point_no"))
    good = good.withColumn("last_page", last_page)
    limited = (F.col("point_no") % 13 == 5) & (F.col("page_no") == 2)
    retried = (F.col("point_no") % 17 == 3) & (F.col("page_no") == 1)
    lines = good.withColumn("attempt", F.explode(F.when(retried, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    failed = limited | (retried & (F.col("attempt") == 1))
    status = F.when(limited, "OVER_QUERY_LIMIT").when(failed, "UNKNOWN_ERROR").otherwise("OK")
    payload = F.struct(status.alias("status"), F.when(failed, "try later").alias("error_message"),
                       F.when(F.col("page_no") < F.col("last_page"), "more").alias("next_page_token"),
                       F.when(~failed, F.col("results")).alias("results"))
    return lines.select(F.concat(F.lit("c"), (F.col("point_no") % 4).cast("string")).alias("city"),
                        "point_no", "page_no", "attempt", payload.alias("payload"))


RESULTS = """select *, cast(floor(event_id / 60) as bigint) point_no,
    cast(floor(event_id % 60 / 20) + 1 as int) page_no, cast(event_id % 20 as int) pos,
    concat('c', cast(cast(floor(event_id / 60) as bigint) % 4 as string)) city from events"""
KEPT = f"""with a as ({RESULTS}), bad as (select distinct point_no from a where point_no % 13 = 5 and page_no = 2),
  r as (select * from a where point_no not in (select point_no from bad))"""


@query(f"{KEPT} select city, point_no, page_no, pos, cast(user_id as string) place_id from r")
def search_pages(t):
    df = pages.read_search_pages(t.spark, landed_pages(t))
    return df.select("city", "point_no", "page_no", "pos", F.col("place.place_id").alias("place_id"))


def landed_with_breaks(t) -> str:
    """The same, with a broken line for page 3 of each eleventh point."""
    lines = page_lines(t).select("point_no", "page_no", F.to_json(F.struct("city", "point_no", "page_no", "attempt", "payload"))
                                 .alias("value"))
    broken = (F.col("point_no") % 11 == 4) & (F.col("page_no") == 3)
    cut = F.when(broken, F.substring("value", F.lit(1), F.length("value") - 9)).otherwise(F.col("value"))
    path = shared_dir(t.spark, "pages")
    lines.select(cut.alias("value")).write.mode("overwrite").text(path)
    return path


WHOLE = f"""with a as ({RESULTS}), bad as (select distinct point_no from a
    where (point_no % 13 = 5 and page_no = 2) or (point_no % 11 = 4 and page_no = 3))
  select city, point_no, page_no, pos, cast(user_id as string) place_id from a
  where point_no not in (select point_no from bad)"""


@query(WHOLE)
def search_pages_broken_lines(t):
    """A line that is not JSON costs its whole point."""
    df = pages.read_search_pages(t.spark, landed_with_breaks(t))
    return df.select("city", "point_no", "page_no", "pos", F.col("place.place_id").alias("place_id"))


@query(f"{KEPT} select city, point_no, page_no, pos, cast(user_id as string) place_id from r")
def stream_pages(t):
    """Each page of a point lands on its own, and a retry after all of them; the stream restarts between."""
    source, log, checkpoint = (shared_dir(t.spark, name) for name in ("landed", "points", "checkpoint"))
    lines = page_lines(t).withColumn("drop_no", F.when(F.col("attempt") > 1, 4).otherwise(F.col("page_no")))
    for i in range(1, 5):
        lines.where(F.col("drop_no") == i).drop("drop_no").write.mode("append").json(source)
        points.start_points(points.read_page_stream(t.spark, source), log, checkpoint).awaitTermination()
    df = points.read_points(t.spark, log)
    return df.select("city", "point_no", "page_no", "pos", F.col("place.place_id").alias("place_id"))


FLAT = """city, cast(user_id as string) place_id, concat(event_type, ' ', cast(event_id as string)) "name",
    case when event_id % 3 = 1 then concat('near ', event_type) else concat(cast(event_id as string), ' Main St') end formatted_address,
    cast(event_id % 90 as double) lat, cast(event_id % 180 - 180 as double) lng, 1 + (event_id % 33) / cast(8 as double) rating,
    user_id user_ratings_total, cast(event_id % 5 as int) price_level, 'OPERATIONAL' business_status,
    case when event_id % 10 = 0 then '[]' else concat('["', event_type, '","food"]') end types, props unknown_field"""


@query(f"{KEPT} select {FLAT} from r")
def flatten_places(t):
    flat = pages.flatten_places(pages.read_search_pages(t.spark, landed_pages(t)))
    return flat.withColumn("unknown_field", F.get_json_object("raw_json", "$.unknown_field")).drop("raw_json")


@query(f"""{KEPT}, k as (select *, row_number() over (partition by city, user_id order by point_no, page_no, pos) rn from r)
  select {FLAT} from k where rn = 1""")
def collect_new_places(t):
    results = pages.read_search_pages(t.spark, landed_pages(t))
    out = P.collect_new(t.spark.createDataFrame([], PLACES), results)
    return out.withColumn("unknown_field", F.get_json_object("raw_json", "$.unknown_field")).drop("raw_json", "fetched_at")


@query("select s_suppkey, true whole_second, true now from supplier")
def fetch_time_facts(t):
    """The stamp is a whole second, at most a minute before the query's own clock."""
    stamp = X.utc_now_seconds()
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(stamp)
    return t.supplier.select("s_suppkey", (stamp == F.date_trunc("second", stamp)).alias("whole_second"),
                             age.between(0, 60).alias("now"))


CHUNK = 500


def landed_census(t, names: dict[str, str]) -> str:
    """Header-plus-rows documents, one per 500 areas, every value as text."""
    cols = [*names, K.ZCTA_COLUMN]
    values = [F.col(c).cast("string") for c in [*names.values(), "zip5"]]
    header = F.array(*[F.lit(c) for c in cols])
    docs = (
        t.zcta.groupBy(F.floor(F.col("zip5").cast("bigint") / CHUNK).alias("chunk"))
        .agg(F.collect_list(F.array(*values)).alias("rows"))
        .select(F.to_json(F.concat(F.array(header), F.col("rows"))).alias("value"))
    )
    path = shared_dir(t.spark, "census")
    docs.write.mode("overwrite").text(path)
    return path


def census_tables(t):
    age, income = landed_census(t, K.AGE_COLUMNS), landed_census(t, K.INCOME_COLUMNS)
    return (tables.read_header_rows_json(t.spark, age, [K.ZCTA_COLUMN, *K.AGE_COLUMNS], whole_file=False),
            tables.read_header_rows_json(t.spark, income, [K.ZCTA_COLUMN, *K.INCOME_COLUMNS], whole_file=False))


@query("select zip5 zcta, census_name name, cast(population_total as string) population from zcta")
def header_rows_json(t):
    age, _ = census_tables(t)
    return age.select(F.col(K.ZCTA_COLUMN).alias("zcta"), F.col("NAME").alias("name"),
                      F.col("S0101_C01_001E").alias("population"))


def document_files(rows):
    """Files of some 300 MB, more than a task reads at once; each is sorted and written by one task."""
    return max(4, rows >> 17)


@query("select cast(doc_id as string) doc_id, text, lang, source from documents")
def header_rows_large_documents(t):
    """Files that are one document each, its values with brackets, quotes and line breaks; they are split at rows."""
    names = ["doc_id", "text", "lang", "source"]
    files = document_files(t.documents.count())
    rows = t.documents.select((F.col("doc_id") % files).alias("file"), F.lit(1).alias("part"), "doc_id",
                              F.concat(F.lit(","), F.to_json(F.array(*[F.col(c).cast("string") for c in names]))).alias("value"))
    ends = rows.select("file").distinct().select("file", F.explode(F.create_map(
        F.lit(0), F.concat(F.lit("["), F.to_json(F.array(*[F.lit(c) for c in names]))), F.lit(2), F.lit("]"))).alias("part", "value"))
    path = shared_dir(t.spark, "documents")
    lines = rows.unionByName(ends, allowMissingColumns=True).repartition(files, "file").sortWithinPartitions("file", "part", "doc_id")
    lines.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
    return tables.read_header_rows_json(t.spark, path, names)


@query("""select zip5, census_name, population_total, median_age, pct_under_18, pct_65_plus, median_household_income
          from zcta where zip5 in (select zip5 from places where length(zip5) = 5)""")
def zip_demographics(t):
    age, income = census_tables(t)
    return P.zip_demographics(age, income, t.places)


def enriched(t):
    fact = t.places.select("place_id", "city", "name", "rating", "user_ratings_total", "price_level",
                           "business_status", "types")
    return J.enrich(fact, t.city_demo, "city").select(*t.spark.createDataFrame([], ENRICHED_PLACES).columns)


@query("select * from enriched_city")
def csv_round_trip(t):
    path = shared_dir(t.spark, "csv")
    tables.write_csv(enriched(t), path)
    return tables.read_csv(t.spark, path, ENRICHED_PLACES)


@query("select doc_id, nullif(text, '') text, lang, source from documents")
def csv_line_breaks(t):
    """Texts with line breaks, quotes and blanks at their ends, in files that are split."""
    path = shared_dir(t.spark, "csv")
    tables.write_csv(t.documents.select("doc_id", "text", "lang", "source"), path)
    return tables.read_csv(t.spark, path, "doc_id bigint, text string, lang string, source string")


@query("select * from enriched_city")
def json_round_trip(t):
    path = shared_dir(t.spark, "json")
    tables.write_json(enriched(t), path)
    return t.spark.read.schema(ENRICHED_PLACES).json(path)


@query("select * from zip_analysis")
def replace_table_round_trip(t):
    return tables.replace_table(P.zip_analysis(t.places, t.zcta), shared_dir(t.spark, "table"))


@query("select l_orderkey, l_quantity from lineitem")
def read_table_columns(t):
    return tables.read_table(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query()
def fetch_time_stamp(t):
    """A clock reading has no SQL to agree with."""
    return t.supplier.select("s_suppkey", X.utc_now_seconds().alias("fetched_at"))


# --- streaming: all events, one row per user and event type

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STREAM_KEYS = ["user_id", "event_type"]


def _ingest(t, mode: str):
    log, checkpoint = shared_dir(t.spark, "log"), shared_dir(t.spark, "checkpoint")
    source = ingest.read_stream(t.spark, t.dir, EVENT_SCHEMA, pathGlobFilter="events.parquet")
    ingest.start_ingest(source, log, STREAM_KEYS, ["ts", "event_id"], checkpoint, mode).awaitTermination()
    return ingest.read_log(t.spark, log, EVENT_SCHEMA)


@query("""select user_id, event_type, event_id, value, props from (
            select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) x
          where rn = 1""")
def stream_upsert(t):
    base = t.spark.createDataFrame([], EVENT_SCHEMA)
    return ingest.current_table(base, _ingest(t, "upsert"), STREAM_KEYS, ["ts", "event_id"]).select(
        *STREAM_KEYS, "event_id", "value", "props")


@query("""select user_id, event_type, event_id, value, props from (
            select *, row_number() over (partition by user_id, event_type order by ts, event_id) rn from events) x
          where rn = 1""")
def stream_insert(t):
    base = t.spark.createDataFrame([], EVENT_SCHEMA)
    return ingest.current_table(base, _ingest(t, "insert"), STREAM_KEYS, ["ts", "event_id"], mode="insert").select(
        *STREAM_KEYS, "event_id", "value", "props")


@query("select distinct user_id, event_type from events")
def stream_new_keys(t):
    source = ingest.read_stream(t.spark, t.dir, EVENT_SCHEMA, pathGlobFilter="events.parquet")
    out, checkpoint = shared_dir(t.spark, "keys"), shared_dir(t.spark, "checkpoint")
    keys = ingest.stream_new_keys(source, STREAM_KEYS).select(*STREAM_KEYS)
    keys.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(
        out).awaitTermination()
    return t.spark.read.schema("user_id bigint, event_type string").parquet(out)


@query("""select place_id, zip5 from (select place_id, zip5, row_number() over (partition by zip5 order by rating desc,
            place_id desc) rn from places where zip5 is not null and rating is not null) x where rn = 1""")
def latest_per_zip(t):
    rows = t.places.where("zip5 is not null and rating is not null").select("place_id", "zip5", "rating")
    return W.latest_per_key(rows, ["zip5"], ["rating", "place_id"]).select("place_id", "zip5")
