import random
import re

import pytest

from placewise.operators import exact_trees as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(autouse=True)
def small_jobs(spark):
    """The data are small and levels are many: no partitions, code generation or plans at run time."""
    want = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in want}
    for settings in (want, old):
        for k, v in settings.items():
            spark.conf.set(k, v)
        if settings is want:
            yield


def grow(rows, w=(1.0, 1.0)):
    """Exhaustive: every cut between neighbouring values of every feature, (n0, n1, feature, threshold, left, right)."""
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    best = None
    if all(n):
        for f in range(len(rows[0][0])):
            ranked = sorted(rows, key=lambda r: r[0][f])
            left = [0, 0]
            for i in range(len(ranked) - 1):
                left[ranked[i][1]] += 1
                x, y = ranked[i][0][f], ranked[i + 1][0][f]
                if x < y:
                    l0, l1, r0, r1 = left[0] * w[0], left[1] * w[1], (n[0] - left[0]) * w[0], (n[1] - left[1]) * w[1]
                    purity = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
                    if best is None or purity > best[0]:
                        best = (purity, f, x / 2 + y / 2 if x / 2 + y / 2 < y else x)
    if best is None:
        return (*n, None, None, None, None)
    _, f, t = best
    return (*n, FEATURES[f], t, grow([r for r in rows if r[0][f] <= t], w), grow([r for r in rows if r[0][f] > t], w))


def nested(model):
    found = {(r.level, r.node): r for r in model.nodes().collect()}

    def at(level, node):
        r = found[level, node]
        below = (None, None) if r.feature is None else (at(level + 1, r.left), at(level + 1, r.right))
        return (r.n0, r.n1, r.feature, r.threshold, *below)

    return at(0, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, *x) for i, (x, y) in enumerate(rows)], "id long, y int, a double, b double, c double")


def noisy(n, seed):
    rng = random.Random(seed)
    rows = [((rng.random() * 10, float(rng.randrange(5)), rng.gauss(0, 1)), 0) for _ in range(n)]
    return [(x, int(x[0] + x[1] + rng.gauss(0, 0.7) > 7)) for x, _ in rows]


def test_equals_the_exhaustive_tree(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)  # 20 blocks a feature
    rows = noisy(1000, 1)
    assert len({x[0] for x, _ in rows}) == 1000
    model = T.fit_exact_trees(frame(spark, rows), "y", FEATURES, "id")
    assert nested(model) == grow(rows)
    scored = {r.id: r.probability_1 for r in model.score(frame(spark, rows), "id").collect()}
    assert scored == {i: float(y) for i, (_, y) in enumerate(rows)}  # all rows differ: the tree has learnt each


def test_deeper_than_thirty_levels(spark):
    rows = [((float(i), 0.0, 0.0), i % 2) for i in range(34)]
    model = T.fit_exact_trees(frame(spark, rows), "y", FEATURES, "id")
    assert nested(model) == grow(rows)
    assert T.fit_exact_trees(frame(spark, rows), "y", FEATURES, "id", max_levels=2).nodes().where("level > 2").count() == 0
    assert len(model.levels) > 31


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None, 1.0), (2, 1, 1.0, 2.0, 1.0), (3, 1, 1.0, float("nan"), 1.0), (4, None, 9.0, 9.0, 9.0),
                                (5, 1, 1.0, 2.0, 1.0)], "id long, y int, a double, b double, c double")
    model = T.fit_exact_trees(df, "y", FEATURES, "id")
    assert nested(model) == (1, 3, "b", float("-inf"), (1, 1, None, None, None, None), (0, 2, None, None, None, None))
    assert [r.probability_1 for r in model.score(df, "id").orderBy("id").collect()] == [0.5, 1.0, 0.5, 1.0, 1.0]
    with pytest.raises(ValueError):
        T.fit_exact_trees(df.where("y is null"), "y", FEATURES, "id")


def test_forest(spark):
    rows = noisy(120, 2)
    df = frame(spark, rows)
    fit = lambda d: T.fit_exact_trees(d, "y", FEATURES, "id", num_trees=6, bootstrap=True, max_features=1, balanced=True, max_levels=5)
    model = fit(df)
    nodes = model.nodes()
    roots = {r.tree: r for r in nodes.where("level = 0").collect()}
    assert len(roots) == 6 and len({(r.n0, r.n1) for r in roots.values()}) > 3 and len({r.feature for r in roots.values()}) > 1
    assert all(abs(r.n0 + r.n1 - 120) < 50 for r in roots.values())
    again = fit(df.repartition(7)).nodes()
    assert again.count() == nodes.count() and again.exceptAll(nodes).count() == 0
    new = noisy(300, 3)
    scored = {r.id: r.probability_1 for r in model.score(frame(spark, new), "id").collect()}
    right = sum((scored[i] > 0.5) == y for i, (_, y) in enumerate(new))
    assert right > 180


def test_rows_of_the_root_stay_spread(spark):
    """The best cuts of few nodes are found where the rows lie: they are not all sent to the task of their node."""
    rows = T.stage(frame(spark, noisy(400, 5)).selectExpr("y label", "array(a, b, c) x", "0 tree", "1L node", "1L n"), "rows")
    plans, made = [], T._best_cuts
    T._best_cuts = lambda *a: plans.append(made(*a)) or plans[-1]
    try:
        T._level(rows, 3, T._cut_points(rows, 3), [1.0, 1.0], None, 1, False)
    finally:
        T._best_cuts = made
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert any("tree_open" in f for f in plans[0].inputFiles()) and "BroadcastHashJoin [tree" in text
    assert not [keys for keys in re.findall(r"SortMergeJoin \[([^]]*)\]", text) if keys.count("#") == 2]


def test_places_among_many_cuts(spark, monkeypatch):
    """More blocks than one step of the search tells apart, and features with fewer values than blocks."""
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "CUT_BASE", 4)
    rows = noisy(300, 6)
    model = T.fit_exact_trees(frame(spark, rows), "y", FEATURES, "id", max_levels=1)
    assert nested(model)[:4] == grow(rows)[:4]
