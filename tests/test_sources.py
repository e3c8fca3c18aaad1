import json

import pytest
from pyspark.sql import functions as F

from placewise import constants as K
from placewise.operators import keyed as W
from placewise.plans import pipelines as P
from placewise.schemas import ENRICHED_PLACES, PLACES
from placewise.sources import pages, tables
from placewise.streaming import ingest


def place(pid, **more):
    return {"place_id": pid, "name": f"n{pid}", "vicinity": f"v{pid}", "geometry": {"location": {"lat": 1.5, "lng": -2.5}},
            "types": ["bar", "food"], **more}


def page(city, point, no, status, results=(), attempt=1):
    return {"city": city, "point_no": point, "page_no": no, "attempt": attempt,
            "payload": {"status": status, "results": list(results)}}


@pytest.fixture
def landed(tmp_path):
    lines = [
        page("a", 1, 1, "OK", [place("p1"), place("p2", extra={"deep": [1, 2]})]), page("a", 1, 2, "OK", [place("p3")]),
        page("a", 2, 1, "OK", [place("lost")]), page("a", 2, 2, "OVER_QUERY_LIMIT"),
        page("a", 3, 1, "UNKNOWN_ERROR"), page("a", 3, 1, "OK", [place("p1", vicinity="", formatted_address="f")], attempt=2),
        page("a", 4, 1, "ZERO_RESULTS"), page("b", 1, 4, "OK", [place("page four")]),
        page("b", 2, 1, "OK", [{"place_id": None, "name": "no id"}, {"place_id": "p1", "rating": 4.5, "price_level": 2}]),
    ]
    file = tmp_path / "pages.json"
    file.write_text("\n".join(json.dumps(x) for x in lines))
    return str(file)


def test_search_pages(spark, landed):
    got = pages.read_search_pages(spark, landed).select("city", "point_no", "page_no", "pos", "place.place_id").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [
        ("a", 1, 1, 0, "p1"), ("a", 1, 1, 1, "p2"), ("a", 1, 2, 0, "p3"), ("a", 3, 1, 0, "p1"), ("b", 2, 1, 0, None),
        ("b", 2, 1, 1, "p1")]))
    with pytest.raises(Exception, match="a search point failed"):
        pages.read_search_pages(spark, landed, on_error="fail").collect()


def test_broken_line(spark, tmp_path):
    file = tmp_path / "x.json"
    file.write_text(json.dumps(page("a", 1, 1, "OK", [place("p")])) + "\n{broken\n")
    assert pages.read_search_pages(spark, str(file)).count() == 1
    with pytest.raises(Exception, match="not JSON"):
        pages.read_search_pages(spark, str(file), on_error="fail").collect()


def test_flatten_and_collect(spark, landed):
    results = pages.read_search_pages(spark, landed)
    flat = {(r["city"], r["place_id"], r["formatted_address"]): r for r in pages.flatten_places(results).collect()}
    assert flat["a", "p1", "f"]["lat"] == 1.5 and flat["a", "p1", "vp1"]["types"] == '["bar","food"]'
    assert json.loads(flat["a", "p2", "vp2"]["raw_json"])["extra"] == {"deep": [1, 2]}
    assert flat["b", "p1", None]["types"] == "[]" and flat["b", "p1", None]["price_level"] == 2
    text = pages.flatten_places(results.where("point_no = 3"), address_order=("formatted_address", "vicinity"))
    assert text.first()["formatted_address"] == "f"
    store = spark.createDataFrame([("a", "p3")], "city string, place_id string")
    for field in spark.createDataFrame([], PLACES).schema.fields[2:]:
        store = store.withColumn(field.name, F.lit(None).cast(field.dataType))
    out = P.collect_new(store, results).collect()
    assert sorted((r["city"], r["place_id"]) for r in out) == [("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "p1")]
    assert {r["formatted_address"] for r in out if r["city"] == "a"} == {"vp1", "vp2", None}


def test_details(spark, tmp_path):
    file = tmp_path / "d.json"
    answer = {"city": "a", "place_id": "p", "status": "OK", "attempt": 1, "result": {
        "formatted_address": "x", "address_components": [{"long_name": "94110", "types": ["postal_code"]}]}}
    file.write_text(json.dumps(answer) + "\n" + json.dumps({"city": "a", "place_id": "q", "status": "NOT_FOUND", "attempt": 1}))
    got = {r["place_id"]: r for r in pages.read_place_details(spark, str(file)).collect()}
    assert got["p"]["postal_code"] == "94110" and got["q"]["postal_code"] is None


def test_header_rows(spark, tmp_path):
    header = [*K.AGE_COLUMNS, K.ZCTA_COLUMN]
    (tmp_path / "age").mkdir()
    (tmp_path / "income").mkdir()
    (tmp_path / "age" / "1.json").write_text(json.dumps(
        [header, ["ZCTA5 00501", "100", "33.5", "20", "x", "00501"], ["ZCTA5 2", "-5.0", None, "1", "2", "99999"]], indent=1))
    # another file may order its columns differently
    (tmp_path / "age" / "2.json").write_text(json.dumps([header[::-1], ["94110", "7", "8", "41", "1e3", "ZCTA5 94110"]]))
    (tmp_path / "income" / "1.json").write_text(json.dumps([["NAME", "B19013_001E", K.ZCTA_COLUMN], ["n", "-666666666", "00501"]]))
    age = tables.read_header_rows_json(spark, str(tmp_path / "age"), header)
    income = tables.read_header_rows_json(spark, str(tmp_path / "income"), [K.ZCTA_COLUMN, *K.INCOME_COLUMNS])
    places = spark.createDataFrame([("00501",), ("94110",), ("123",), (None,)], "zip5 string")
    got = sorted(tuple(r) for r in P.zip_demographics(age, income, places).collect())
    assert got == [("00501", "ZCTA5 00501", 100, 33.5, 20.0, None, -666666666),
                   ("94110", "ZCTA5 94110", 1000, 41.0, 8.0, 7.0, None)]
    with pytest.raises(Exception, match="no column nothing"):
        tables.read_header_rows_json(spark, str(tmp_path / "age"), ["nothing"]).collect()


def test_city_demographics(spark):
    places = spark.createDataFrame([("New York",), ("New York City",), ("Chicago",), ("Boston",), (None,)], "city string")
    age = spark.createDataFrame([("36", "51000", "New York city, New York", "8000000", "37", "20", "15")],
                                "state string, place string, " + ", ".join(f"{c} string" for c in K.AGE_COLUMNS))
    income = spark.createDataFrame([("36", "51000", "70000"), ("17", "14000", "60000.0")],
                                   "state string, place string, B19013_001E string")
    table, missing = P.city_demographics(places, age, income)
    got = {r["city"]: r for r in table.collect()}
    assert set(got) == {"New York", "New York City", "Chicago"} and [r["city"] for r in missing.collect()] == ["Boston"]
    assert got["New York City"]["population_total"] == 8000000 and got["Chicago"]["median_household_income"] == 60000
    assert got["Chicago"]["population_total"] is None and got["New York"]["census_place_fips"] == "51000"


def test_csv_keeps_awkward_text(spark, tmp_path):
    row = ("p", "New\nYork", 'say "hi", ok', 4.5, None, 2, None, '["a","b"]', "x, y", 1, None, 2.5, 3.5, 4, "06", "00001")
    df = spark.createDataFrame([row], ENRICHED_PLACES)
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tuple(tables.read_csv(spark, str(tmp_path / "csv"), ENRICHED_PLACES).first()) == row
    (tmp_path / "nan.csv").write_text("a,b\nNaN,1\n2.5,\n")
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "nan.csv"), "a double, b int").collect()]
    assert got == [(None, 1), (2.5, None)]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = tables.replace_table(spark.range(3), path)
    assert first.count() == 3
    assert tables.replace_table(first.where("id > 0"), path).count() == 2
    with pytest.raises(Exception, match="no luck"):
        tables.replace_table(spark.range(9).where("id < 0 or raise_error('no luck') is null"), path)
    assert tables.read_table(spark, path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert tables.replace_table(spark.range(5), path).count() == 5
    other = tables.replace_table(tables.read_table(spark, path).where("id > 1"), str(tmp_path / "u"))
    assert other.count() == 3


SCHEMA = "city string, id string, v int, at int"


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("mode,want", [("upsert", {"p1": 9, "p2": None, "p3": 3}), ("insert", {"p1": 1, "p2": 2, "p3": 3})])
def test_incremental_ingest_restarts(spark, tmp_path, mode, want):
    src, log, ckpt = (str(tmp_path / n) for n in ("src", "log", "ckpt"))
    base = spark.createDataFrame([], SCHEMA)
    assert ingest.read_log(spark, log, SCHEMA).count() == 0

    def run():
        stream = ingest.read_stream(spark, src, SCHEMA)
        ingest.start_ingest(stream, log, ["city", "id"], ["at"], ckpt, mode).awaitTermination()

    land(spark, src, ("a", "p1", 5, 9), ("a", "p1", 1, 1), ("a", "p2", 2, 1)) if mode == "insert" else land(
        spark, src, ("a", "p1", 5, 1), ("a", "p2", 2, 1))
    run()
    run()  # nothing new has landed
    land(spark, src, ("a", "p1", 9, 0), ("a", "p2", None, 0), ("a", "p3", 3, 0))
    run()
    table = ingest.read_log(spark, log, SCHEMA)
    out = ingest.current_table(base, table, ["city", "id"], ["at"], mode=mode)
    assert {r["id"]: r["v"] for r in out.collect()} == want
    # a replayed batch writes the same folder again
    rows = spark.createDataFrame(table.where("batch_id = 1").drop("batch_id").collect(), SCHEMA)
    rows.write.mode("overwrite").parquet(f"{log}/batch_id=1")
    again = ingest.current_table(base, ingest.read_log(spark, log, SCHEMA), ["city", "id"], ["at"], mode=mode)
    assert {r["id"]: r["v"] for r in again.collect()} == want


def test_stream_new_keys(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))

    def run():
        keys = ingest.stream_new_keys(ingest.read_stream(spark, src, SCHEMA), ["city", "id"]).select("city", "id")
        keys.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(
            out).awaitTermination()

    land(spark, src, ("a", "x", 1, 1), ("a", "x", 2, 2), (None, "n", 1, 1))
    run()
    land(spark, src, ("a", "x", 3, 3), ("b", "x", 1, 1))
    run()
    got = sorted(tuple(r) for r in spark.read.schema("city string, id string").parquet(out).collect())
    assert got == [("a", "x"), ("b", "x")]


def test_stream_new_keys_within_a_delay(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "id string, ts timestamp_ntz"

    def land_and_run(*rows):
        spark.createDataFrame(list(rows), "id string, t string").selectExpr(
            "id", "cast(t as timestamp_ntz) ts").coalesce(1).write.mode("append").parquet(src)
        keys = ingest.stream_new_keys(ingest.read_stream(spark, src, schema), ["id"], "ts", "1 hour")
        keys.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(
            out).awaitTermination()

    land_and_run(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00"))
    land_and_run(("a", "2024-01-01 00:30:00"), ("c", "2024-01-01 00:30:00"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_latest_per_key_is_stable(spark):
    df = spark.range(1000).selectExpr("id % 7 k", "id v")
    want = sorted(tuple(r) for r in W.latest_per_key(df, ["k"], ["v"]).collect())
    assert want == sorted(tuple(r) for r in W.latest_per_key(df.repartition(9), ["k"], ["v"]).collect())


def test_large_documents_grow_in_number():
    """One task writes a file: its size must not follow the input."""
    from verification.q_sources import document_files
    assert document_files(0) == document_files(50000) == 4
    assert all(n / document_files(n) < 1 << 18 for n in (10 ** 6, 10 ** 7, 10 ** 8))
