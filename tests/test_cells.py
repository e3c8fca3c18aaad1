import pytest
from pyspark.sql import functions as F

from placewise.operators import aggregates as A, cells as C

CELLS = ["city", "price"]
SCHEMA = "city string, price int, id bigint, rating double, user_ratings_total int"


@pytest.fixture
def facts(spark):
    rows = [("a", 1, 5, 4.0, 10), ("a", 1, 5, None, 20), ("a", 2, 5, 3.5, None), ("a", None, 40_000, 2.0, 7), ("b", 1, -3, 1.0, 1),
            ("b", 2, None, None, None), (None, 2, 5, 5.0, 2), ("c", 3, 2**40, 4.5, 9)]
    return spark.createDataFrame(rows + [("d", i % 4, i * 7 - 9000, i % 9 / 2, i) for i in range(5000)], SCHEMA)


@pytest.mark.parametrize("keep", ["true", "price in (1, 2)", "city = 'a'", "city = 'b' and price = 2", "city = 'no'", "price is null"])
def test_any_filter_from_the_cells(facts, as_rows, keep):
    sums, maps = C.cell_sums(facts, CELLS, ["rating", "user_ratings_total"]), C.cell_bitmaps(facts, CELLS, "id")
    assert as_rows(C.kpis_of_cells(sums.where(keep))) == as_rows(A.kpis(facts.where(keep)))
    assert as_rows(C.distinct_of_cells(maps.where(keep))) == as_rows(A.distinct_count(facts.where(keep), "id"))
    per_city = facts.where(keep).where("id is not null").groupBy("city").agg(F.count_distinct("id"))
    assert as_rows(C.distinct_of_cells(maps.where(keep), ["city"])) == as_rows(per_city)


def test_loads_merge(facts, as_rows):
    """Cells of two loads that share ids are the cells of both together."""
    half = F.col("user_ratings_total") % 2 == 0
    parts = [facts.where(half), facts.where(~F.coalesce(half, F.lit(False)))]
    sums = [C.cell_sums(p, CELLS, ["rating"]) for p in parts]
    maps = [C.cell_bitmaps(p, CELLS, "id") for p in parts]
    assert as_rows(C.merge_sums(sums[0].unionByName(sums[1]), CELLS)) == as_rows(C.cell_sums(facts, CELLS, ["rating"]))
    both = C.merge_bitmaps(maps[0].unionByName(maps[1]), CELLS)
    assert as_rows(C.distinct_of_cells(both, CELLS)) == as_rows(C.distinct_of_cells(C.cell_bitmaps(facts, CELLS, "id"), CELLS))
