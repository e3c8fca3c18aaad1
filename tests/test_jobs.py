import json
import random

from placewise import constants as K, jobs


def test_from_pages_to_statistics(spark, tmp_path):
    rng = random.Random(1)
    lines, answers = [], []
    for city in ("Chicago", "New York", "Elsewhere"):
        for point in range(1, 13):
            results = [{"place_id": f"{city[0]}{rng.randrange(150)}", "name": "x", "rating": rng.choice([4.0, 4.6, None]),
                        "price_level": rng.choice([1, 2, 3]), "user_ratings_total": rng.randrange(1, 900),
                        "types": ["restaurant", rng.choice(["bar", "cafe"])]} for _ in range(10)]
            lines.append({"city": city, "point_no": point, "page_no": 1, "attempt": 1,
                          "payload": {"status": "OK", "results": results}})
            answers += [{"city": city, "place_id": r["place_id"], "status": "OK", "attempt": 1, "result": {
                "formatted_address": "a", "address_components": [
                    {"long_name": f"{10000 + int(r['place_id'][1:]) % 9}-1", "types": ["postal_code"]}]}} for r in results]

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    pages = put("pages.json", "\n".join(map(json.dumps, lines)))
    details = put("details.json", "\n".join(map(json.dumps, answers)))
    names = list(K.AGE_COLUMNS)
    age = put("age.json", json.dumps([[*names, K.ZCTA_COLUMN], *[
        [f"Z{z}", str(4000 + 100 * z), str(30 + z), "20", "15", str(10000 + z)] for z in range(9)]]))
    income = put("income.json", json.dumps([["B19013_001E", K.ZCTA_COLUMN], *[
        [str(50000 + 1000 * (z * 7 % 9)), str(10000 + z)] for z in range(9)]]))
    city_age = put("city_age.json", json.dumps([[*names, "state", "place"],
                                                ["Chicago city, Illinois", "2700000", "35", "20", "14", "17", "14000"]]))
    city_income = put("city_income.json", json.dumps([["B19013_001E", "state", "place"], ["71000", "17", "14000"]]))
    out = {n: str(tmp_path / n) for n in ("c", "b", "z", "k", "s", "i", "again", "capped", "text", "g")}

    def read(job, name):
        return spark.read.parquet(f"{out[job]}/{name}")

    jobs.run(spark, ["collect", "--pages", pages, "--out", out["c"]])
    assert read("c", "places").groupBy("city", "place_id").count().where("count > 1").count() == 0
    assert read("c", "progress").count() == 36 and read("c", "stops").count() == 3
    jobs.run(spark, ["backfill", "--store", out["c"] + "/places", "--details", details, "--out", out["b"]])
    n = read("c", "places").count()
    assert tuple(read("b", "counts").first()) == (n, n, 0)
    assert read("b", "places").where("zip5 is null or details_fetched_at is null").count() == 0
    # a second crawl into the backfilled store: known places stay as they are, a broken line is reported
    more = put("more.json", json.dumps({**lines[0], "payload": {"status": "OK", "results": [
        {**lines[0]["payload"]["results"][0], "name": "changed"}, {"place_id": "new", "name": "n"}]}})
               + '\n{"city": "Chicago", "point_no": 7, "payl')
    jobs.run(spark, ["collect", "--store", out["b"] + "/places", "--pages", more, "--out", out["again"]])
    assert read("again", "places").count() == n + 1 and read("again", "places").where("name = 'changed'").count() == 0
    assert read("again", "places").where("place_id = 'new' and fetched_at is not null and postal_code is null").count() == 1
    assert [tuple(r)[:2] for r in read("again", "unreadable").collect()] == [("Chicago", 7)]
    jobs.run(spark, ["text-search", "--store", out["b"] + "/places", "--pages", pages, "--out", out["text"]])
    assert read("text", "places").count() == n and read("text", "counts").selectExpr("sum(rows)").first()[0] == n
    jobs.run(spark, ["collect-capped", "--pages", pages, "--out", out["capped"]])
    assert read("capped", "places").count() == n and read("capped", "counts").where("target_met").count() == 0
    jobs.run(spark, ["grid", "--out", out["g"]])
    assert read("g", "plateau_points").count() == 196 + 336 + 702 + 990
    jobs.run(spark, ["zips", "--places", out["b"] + "/places", "--age", age, "--income", income, "--out", out["z"]])
    assert read("z", "places_by_zip").where("population_total is null").count() == 0
    assert read("z", "zip_analysis").selectExpr("sum(place_count)").first()[0] == n
    jobs.run(spark, ["statistics", "--zips", out["z"] + "/zip_analysis", "--out", out["s"]])
    assert read("s", "correlation").count() == 25 and read("s", "price_on_log_income").first()["n"] == 9
    jobs.run(spark, ["cities", "--places", out["b"] + "/places", "--age", city_age, "--income", city_income,
                     "--out", out["k"]])
    assert [r["city"] for r in read("k", "cities_without_codes").collect()] == ["Elsewhere"]
    assert read("k", "places_by_city").count() == n
    jobs.run(spark, ["insights", "--places", out["k"] + "/places_by_city", "--out", out["i"]])
    assert {r["type"] for r in read("i", "top_types").collect()} == {"bar", "cafe"}
    assert read("i", "density").first()["census_name"] == "Chicago city, Illinois"
    assert read("i", "review_trend").count() == 100
