"""Plan shapes that matter at scale."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from placewise.operators import keyed as W, split as SP, topk as TK
from verification import catalog
from verification.standins import Tables

SF = "/root/testdata/sf0.001"
# these write files or fit models when called
NO_SQL_FITS = {"logistic_metrics", "logistic_report", "forest_threshold_sweep", "forest_report", "forest_chosen_report",
               "feature_importance", "kmeans_profile", "cluster_points", "kmeans_embeddings"}
EAGER = NO_SQL_FITS | {"logistic_optimum", "classifier_scores", "report_support", "importance_facts", "kmeans_fixed_point",
                       "kmeans_embeddings_fixed_point"}
NO_SQL = NO_SQL_FITS | {"fetch_time_stamp"}
catalog.load_all()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - EAGER))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in text, bad


def test_one_row_per_key_is_cut_before_the_shuffle(spark):
    t = Tables(spark, SF)
    keep = plan(W.latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    assert "row_number(), 1, Partial" in keep
    top = plan(TK.top_k_per_group(t.orders, "o_orderpriority", [("o_totalprice", -1), "o_orderkey"], 5))
    assert "row_number(), 5, Partial" in top


def test_small_batch_upsert_has_no_full_join(spark):
    t = Tables(spark, SF)
    args = (t.orders, t.orders.where("o_orderstatus = 'F'"), ["o_orderkey"], ["o_totalprice"], ["o_orderdate"])
    assert "FullOuter" in plan(W.upsert(*args))
    assert "FullOuter" not in plan(W.upsert(*args, small_batch=True))


def test_flagship_reads_only_what_it_needs(spark):
    text = plan(entry.entry(spark))
    schemas = [line.split("ReadSchema: ")[1] for line in text.splitlines() if "ReadSchema" in line]
    assert schemas and not any("o_totalprice" in s or "p_name" in s or "c_mktsegment" in s for s in schemas)


def test_a_row_per_class_needs_no_limit(spark):
    rows = spark.range(60_000).selectExpr("id", "id % 20000 y")
    parts = SP.stratified_split(rows, "y", "id", 0.34)
    assert {(r["part"], r["count"]) for r in parts.groupBy("part").count().collect()} == {("test", 20_400), ("train", 39_600)}
    assert SP.balanced_weights(rows, "y").where("weight = 1.0").count() == 60_000


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL
