import pytest
from pyspark.sql import functions as F

from placewise.operators import joins as J, keyed as W


@pytest.mark.parametrize("small", [False, True])
def test_upsert_rules(table, as_rows, small):
    target = table("k string, v double, z string", ("a", 1.0, "z1"), ("b", 2.0, "z2"))
    batch = table("k string, v double, at int", ("a", 9.0, 1), ("a", None, 2), ("c", 3.0, 1))
    out = W.upsert(target, batch, ["k"], ["v"], ["at"], small_batch=small)
    want = [("a", None, "z1"), ("b", 2.0, "z2"), ("c", 3.0, None)]
    assert as_rows(out) == want
    assert as_rows(W.upsert(out, batch, ["k"], ["v"], ["at"], small_batch=small)) == want
    assert out.columns == target.columns


@pytest.mark.parametrize("small", [False, True])
def test_upsert_inserts_whole_rows(table, as_rows, small):
    target = table("k string, v int, w int, z int", ("a", 1, 1, 1))
    batch = table("k string, v int, w int, other int", ("a", 5, 6, 0), ("b", 7, 8, 0))
    assert as_rows(W.upsert(target, batch, ["k"], ["v"], ["v"], small_batch=small)) == [("a", 5, 1, 1), ("b", 7, 8, None)]


@pytest.mark.parametrize("small", [False, True])
def test_upsert_touches_written_rows_only(table, as_rows, small):
    target = table("k int, v int, at string", (1, 1, "old"), (2, 2, "old"))
    batch = table("k int, v int", (2, 5), (3, 6))
    out = W.upsert(target, batch, ["k"], ["v"], ["v"], touch={"at": F.lit("new")}, small_batch=small)
    assert as_rows(out) == [(1, 1, "old"), (2, 5, "new"), (3, 6, "new")]


def test_upsert_refuses_null_keys_and_missing_order(table):
    target, batch = table("k int, v int", (1, 1)), table("k int, v int", (None, 2), (1, 3))
    with pytest.raises(ValueError):
        W.upsert(target, batch, ["k"], ["v"], [])
    with pytest.raises(Exception, match="null in key columns"):
        W.upsert(target, batch, ["k"], ["v"], ["v"]).collect()


def test_insert_new_keeps_first_and_is_idempotent(table, as_rows):
    target = table("k int, v string", (1, "kept"))
    batch = table("k int, v string, at int", (1, "no", 0), (2, "later", 5), (2, "first", 1), (None, "x", 0))
    out = W.insert_new(target, batch, ["k"], ["at"])
    assert as_rows(out) == [(1, "kept"), (2, "first")]
    assert as_rows(W.insert_new(out, batch, ["k"], ["at"])) == as_rows(out)


def test_insert_new_into_a_wider_store(table, as_rows):
    target = table("k string, v int, zip string, at string", ("a", 1, "9", "old"))
    batch = table("k string, v int, n int", ("a", 5, 0), ("", 6, 0), (None, 7, 0), ("b", 8, 0))
    out = W.insert_new(target, batch, ["k"], ["n"], touch={"at": F.lit("now")})
    assert as_rows(out) == [("a", 1, "9", "old"), ("b", 8, None, "now")] and out.columns == target.columns


def test_backfill(table, as_rows):
    target = table("city string, id string, zip string, addr string",
                   ("c", "ok", None, "old"), ("c", "nozip", None, "old"), ("c", "miss", None, "old"),
                   ("c", "set", "1", "old"), ("c", None, None, "old"), ("c", "none", None, "old"))
    details = table("city string, id string, status string, zip string, addr string, at int",
                    ("c", "ok", "OVER_QUERY_LIMIT", None, None, 1), ("c", "ok", "OK", "9", "new", 2),
                    ("c", "nozip", "OK", None, "new", 1), ("c", "miss", "NOT_FOUND", "8", "new", 1),
                    ("c", "set", "OK", "7", "new", 1))
    args = (target, details, ["city", "id"], "zip")
    out = W.backfill(*args, ["zip", "addr"], ["at"])
    assert as_rows(out, "id", "zip", "addr") == [
        ("miss", None, "old"), ("none", None, "old"), ("nozip", None, "new"), ("ok", "9", "new"),
        ("set", "1", "old"), (None, None, "old")]
    assert tuple(W.backfill_stats(*args, ["at"]).first()) == (4, 2, 1)


def test_enrich_keeps_every_fact_row(table, as_rows):
    fact = table("id int, k string", *[(i, "hot") for i in range(50)], (90, None), (91, "gone"), (92, "b"))
    dim = table("k string, v int", ("hot", 1), ("b", 2), ("unused", 3))
    plain, salted = J.enrich(fact, dim, "k"), J.enrich(fact, dim, "k", salted=True)
    assert plain.count() == fact.count()
    assert as_rows(plain, "id", "k", "v") == as_rows(salted, "id", "k", "v")


def test_salted_join_with_repeated_dimension_keys(table, as_rows):
    fact = table("id int, k int", *[(i, i % 3) for i in range(30)])
    dim = table("k int, v string", (0, "x"), (0, "y"), (1, "z"))
    assert as_rows(J.enrich(fact, dim, "k", salted=True), "id", "v") == as_rows(J.enrich(fact, dim, "k"), "id", "v")


def test_small_joins(table, as_rows):
    fact = table("k string", ("a",), ("a",), ("b",), (None,))
    dim = table("k string, v int", ("a", 1), ("z", 2))
    assert as_rows(J.unmapped(fact, dim, "k")) == [("b",)]
    assert as_rows(J.restrict_dim(dim, fact, "k")) == [("a", 1)]
    mapped = J.lookup(fact, {"a": {"state": "06"}, "alias": {"state": "06"}}, "k")
    assert as_rows(mapped) == [("a", "06"), ("a", "06")]
    assert J.lookup(fact, {}, "k").count() == 0
