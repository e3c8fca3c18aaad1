import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placewise import constants as K
from placewise.operators import metrics as M, models as ML, split as SP
from placewise.plans import pipelines as P


def test_split_quotas_and_repeatability(table, as_rows):
    labels = ["a"] * 83 + ["b"] * 41 + ["c"] * 7 + [None] * 5
    df = table("id int, y string", *enumerate(labels))
    parts = SP.stratified_split(df, "y", "id", 0.2, 42)
    counts = Counter((r["y"], r["part"]) for r in parts.collect())
    # ceil(131 * 0.2) = 27 = 16.6 + 8.2 + 1.4 -> 17, 8, 1 and one more by the next largest remainder
    assert sum(n for (_, part), n in counts.items() if part == "test") == 27
    quotas = {r["y"]: r["quota"] for r in SP.class_quotas(SP.class_counts(df, "y"), "y", 0.2).collect()}
    assert {y: counts[y, "test"] for y in "abc"} == quotas
    assert as_rows(parts.select("id").distinct()) == as_rows(df.where("y is not null").select("id"))
    assert as_rows(parts) == as_rows(SP.stratified_split(df.repartition(8), "y", "id", 0.2, 42))
    assert as_rows(parts) != as_rows(SP.stratified_split(df, "y", "id", 0.2, 1))


def test_split_takes_smallest_hashes(table):
    import hashlib
    df = table("id int, y int", *[(i, i % 2) for i in range(300)])
    got = {r["id"] for r in SP.stratified_split(df, "y", "id", 0.3, 9).where("part = 'test'").collect()}
    want = set()
    for y in (0, 1):
        ids = sorted((i for i in range(300) if i % 2 == y), key=lambda i: hashlib.md5(f"9{i}".encode()).hexdigest())
        want |= set(ids[:45])
    assert got == want


def test_balanced_weights(table, as_rows):
    df = table("y int", (0,), (0,), (0,), (1,))
    assert as_rows(SP.balanced_weights(df, "y").distinct()) == [(0, pytest.approx(4 / 6)), (1, 2.0)]


def test_metrics_without_positive_prediction(table):
    df = table("y int, p int", (1, 0), (0, 0), (0, 0))
    assert tuple(M.binary_metrics(df, "y", "p").first()) == (pytest.approx(2 / 3), 0.0, 0.0)
    cells = {(r["actual"], r["predicted"]): r["rows"] for r in M.confusion(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    report = {r["class"]: r for r in M.class_report(df, "y", "p").collect()}
    assert report["1"]["f1"] == 0.0 and report["0"]["recall"] == 1.0 and report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert report["macro avg"]["precision"] == pytest.approx(1 / 3) and report["weighted avg"]["support"] == 3


def test_pick_threshold(table):
    schema = "threshold double, accuracy double, precision double, recall double"
    tie = table(schema, (0.3, .5, .4, .9), (0.4, .5, .6, .7), (0.5, .5, .6, .56), (0.6, .5, .9, .1))
    assert M.pick_threshold(tie).first()["threshold"] == 0.4
    low = table(schema, (0.3, .5, .4, .5), (0.4, .5, .5, .5), (0.5, .5, .9, .01))
    assert M.pick_threshold(low).first()["threshold"] == 0.4


def places(table, n=600):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        reviews = rng.choice([None, 5, 50, 500, 5000])
        rating = rng.choice([4.0, 4.3, 4.7]) if reviews is None or reviews < 500 else rng.choice([4.5, 4.7, 4.9])
        rows.append((f"p{i}", rng.choice(["SF", "LA", "NY", None]), rating if i % 20 else None, reviews,
                     rng.choice([None, 1, 2, 3]), rng.choice([1000, 2000, 9000]), 30.0 + i % 9, 20.0, 12.0, 50000 + i % 7))
    return table("place_id string, city string, rating double, user_ratings_total bigint, price_level int, "
                 "population_total bigint, median_age double, pct_under_18 double, pct_65_plus double, "
                 "median_household_income bigint", *rows)


def test_features_unknown_category_is_all_zero(table):
    t = ML.classifier_table(places(table))
    model = ML.fit_features(t, K.NUMERIC_FEATURES, K.CATEGORICAL_FEATURES)
    strange = t.limit(1).withColumn("city", F.lit("elsewhere"))
    vector = model.transform(strange).first()["features"].toArray()
    assert len(vector) == 7 + 3 and not vector[7:].any()
    known = model.transform(t.where("city = 'SF'").limit(1)).first()["features"].toArray()
    assert list(known[7:]) == [0.0, 0.0, 1.0]
    # a constant column is centred, not divided by zero
    assert model.stats["pct_under_18"]["std"] == 0.0 and known[K.NUMERIC_FEATURES.index("pct_under_18")] == 0.0


def test_forest_and_logistic_end_to_end(table):
    df = places(table)
    forest = P.classify(df, num_trees=15, max_depth=5)
    assert forest["sweep"].count() == 9 and forest["chosen"].count() == 1
    n = df.where("rating is not null").count()
    assert sum(r["rows"] for r in forest["confusion"].collect()) == -(-n // 5)
    best = max(r["accuracy"] for r in forest["sweep"].collect())
    assert best > 0.6
    again = P.classify(df.repartition(5), num_trees=15, max_depth=5)
    assert forest["scored"].select("place_id").exceptAll(again["scored"].select("place_id")).count() == 0
    metrics = P.classify(df, model="logistic")["metrics"].first()
    assert metrics["accuracy"] > 0.55


def test_logistic_reaches_the_penalised_optimum(table):
    """The gradient of the weighted, penalised loss is zero at the fitted coefficients."""
    import numpy as np
    t = ML.classifier_table(places(table))
    fitted = ML.fit_logistic(t, "high_rated", K.NUMERIC_FEATURES, K.CATEGORICAL_FEATURES)
    rows = SP.balanced_weights(fitted.features.transform(t), "high_rated").select("features", "high_rated", "weight").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y, w = np.array([r["high_rated"] for r in rows]), np.array([r["weight"] for r in rows])
    beta, b0 = fitted.model.coefficients.toArray(), fitted.model.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b0)))
    assert np.abs(x.T @ (w * (p - y)) + beta).max() < 0.05 and abs(float(np.sum(w * (p - y)))) < 0.05


def test_importance_names(table):
    t = ML.classifier_table(places(table))
    forest = ML.fit_forest(t, "high_rated", K.NUMERIC_FEATURES, K.CATEGORICAL_FEATURES, num_trees=10, max_depth=4)
    got = ML.feature_importance(forest, t, 15).collect()
    assert {r["feature"] for r in got} == {*K.NUMERIC_FEATURES, "city_SF", "city_LA", "city_NY"}
    assert got[0]["feature"] == "log_reviews" and sum(r["importance"] for r in got) == pytest.approx(1)


def test_kmeans_numbers_clusters_by_centre(table):
    pts = [(c * 10 + d, c * 5 - d) for c in range(4) for d in (0.0, 0.1, 0.2)]
    df = table("x double, y double", *pts)
    got = {(r["x"], r["y"]): r["cluster"] for r in ML.kmeans_points(df, ["x", "y"], 4, 1).collect()}
    assert all(got[p] == i // 3 for i, p in enumerate(pts))


def test_facts_turn_red_for_models_that_learnt_nothing(table):
    from verification import q_models as Q
    t = ML.classifier_table(places(table))
    options = dict(label="high_rated", numeric=K.NUMERIC_FEATURES, categorical=K.CATEGORICAL_FEATURES, partitions=4, key="place_id")
    optimum = {}
    for rounds in (0, 1000):
        slopes = ML.logistic_slopes(ML.fit_logistic(t, max_iter=rounds, **options), t, "high_rated").collect()
        optimum[rounds] = all(abs(r.slope) <= 1e-3 * r.scale for r in slopes)
    assert optimum == {0: False, 1000: True}
    rows = table("k long, x double, city string, large int", *[(i, float(i * 37 % 100), "c", int(i * 37 % 100 > 60)) for i in range(300)])
    shuffled = rows.selectExpr("k", "x", "city", "cast(k % 3 = 0 as int) large")
    for fit, more in ((ML.fit_forest, dict(num_trees=5, max_depth=4)), (ML.fit_logistic, dict(c=1e4))):
        facts = [tuple(Q.learnt_facts(fit(d, "large", ["x"], ["city"], partitions=4, key="k", **more).score(rows)).first())
                 for d in (rows, shuffled)]
        assert facts[0] == (300, True, True) and facts[1] != facts[0]
    near = table("cluster int, x double", *[(int(i > 5), float(i)) for i in range(10)])
    assert Q._fixed_point(near, ["x"]).first().nearer_elsewhere == 0
    assert Q._fixed_point(near.selectExpr("cast(x % 2 as int) cluster", "x"), ["x"]).first().nearer_elsewhere > 0


def test_equal_rows_are_dealt_evenly(table):
    """A third of all rows have equal features: the key spreads them, and the model stays the same."""
    rows = [(i, 1.0 if i % 3 == 0 else float(i), "c", int(i % 7 < 3)) for i in range(3000)]
    df = table("k long, x double, city string, y int", *rows)
    _, train = ML._training(df, "y", ["x"], ["city"], 8, "k")
    from pyspark.sql import functions as F
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    train.unpersist()
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
    one, two = (ML.fit_logistic(df, "y", ["x"], ["city"], partitions=n, key="k").model.coefficients.toArray() for n in (4, 8))
    assert one == pytest.approx(two, rel=1e-4, abs=1e-6)


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ML, "PARTITION_ROWS", 100)
    assert ML._partitions(spark.range(3001), 8) == 31 and ML._partitions(spark.range(50), 8) == 8
