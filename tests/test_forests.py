import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from placewise.operators import forests as T


def frame(table, rows):
    """Rows settled in four partitions."""
    df = table("id long, x array<double>, y int", *rows).withColumn("features", array_to_vector("x"))
    return df.repartitionByRange(4, "id").sortWithinPartitions("id")


def best_split(rows, w):
    """Every cut between neighbouring values of every feature."""
    found = None
    for f in range(len(rows[0][0])):
        for a in sorted({x[f] for x, _ in rows})[:-1]:
            n = [[sum(w[k] for x, y in rows if y == k and (x[f] <= a) == side) for k in (0, 1)] for side in (True, False)]
            purity = sum((s[0] ** 2 + s[1] ** 2) / (s[0] + s[1]) for s in n)
            if found is None or purity > found[0] + 1e-9:
                found = purity, f, a
    return found


def test_part_takes_the_best_of_all_cuts():
    rng = random.Random(4)
    rows = [((rng.randrange(9), rng.randrange(4), rng.randrange(2)), 0) for _ in range(200)]
    rows = [(x, int(x[0] + 2 * x[1] + rng.random() * 4 > 8)) for x, _ in rows]
    w = [0.7, 1.9]
    bins, labels = np.array([x for x, _ in rows], np.uint8).T, np.array([y for _, y in rows])
    (feature, cut, left, share), gains = T.grow_part(bins, np.ones(200, int), labels, w, 3, 30, 9, np.random.default_rng(1))
    purity, f, at = best_split(rows, w)
    assert (feature[0], cut[0]) == (f, at) and gains[f] > 0
    leaf = T._walk(feature, cut, left, bins, np.zeros(200, np.int64))
    for node in set(leaf.tolist()):
        n = [w[k] * int((labels[leaf == node] == k).sum()) for k in (0, 1)]
        assert share[node] == pytest.approx(n[1] / sum(n))
    for node in np.flatnonzero(feature >= 0):
        pair = share[left[node]:left[node] + 2]
        assert (feature[left[node]:left[node] + 2] >= 0).any() or (pair[0] > 0.5) != (pair[1] > 0.5)


def test_wide_nodes_are_split_as_jobs(table, monkeypatch):
    """One feature leaves no choice: the forest is the same whether a node's rows meet in one task or stay where they are."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(90))], rng.randrange(2)) for i in range(700)]
    rows = [(i, x, int(x[0] * 7 % 10 > 4)) for i, x, _ in rows]
    found = []
    for local in (T.LOCAL, 60):
        monkeypatch.setattr(T, "LOCAL", local)
        model = T.fit_forest(frame(table, rows), "features", "y", [1.0, 2.0], 5, 30, 256, 3)
        scored = model.score(frame(table, rows), "features").select("id", "y", "probability_1").collect()
        found.append({r.id: r.probability_1 for r in scored})
        assert len(scored) == 700 and np.mean([(r.probability_1 > 0.5) == r.y for r in scored]) > 0.99
    assert len(model.top.tree) > 50 and model.parts.count() > 25
    assert found[0] == found[1] and model.importances.tolist() == [1.0]


def test_rows_do_not_depend_on_chunks(table, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random(), float(rng.randrange(3)), 1.0], i % 2) for i in range(400)]
    scores = []
    for chunk in (T.CHUNK, 20):
        monkeypatch.setattr(T, "CHUNK", chunk)
        model = T.fit_forest(frame(table, rows), "features", "y", [1.0, 1.0], 7, 4, 16, 3)
        scores.append({r.id: r.probability_1 for r in model.score(frame(table, rows), "features").collect()})
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 20
    assert [len(c) for c in model.cuts] == [15, 15, 2, 0] and model.importances.sum() == pytest.approx(1)


def test_a_task_gets_the_rows_once_for_many_trees(table, spark):
    """Thirty trees, whose rows go to 24 tasks and not once to each tree."""
    rng = random.Random(7)
    rows = frame(table, [(i, [rng.random(), rng.random()], i % 2) for i in range(300)])
    model = T.fit_forest(rows, "features", "y", [1.0, 1.0], 30, 3, 16, 3)
    assert model.parts.count() == 30
    chunks = spark.range(3)
    sent = T._to_groups(chunks, 30)
    assert sent.count() == 3 * T.GROUPS and T._to_groups(chunks, 5).count() == 3 * 5
    dealt = sent.repartition(T.SPREAD, "part").select("part", F.spark_partition_id().alias("task")).distinct()
    assert dealt.count() == dealt.select("task").distinct().count() == T.GROUPS
    one = {r.id: r.probability_1 for r in model.score(rows, "features").collect()}
    parts = {r.node: T._unpack_nodes(r.nodes) for r in model.parts.collect()}
    for r in rows.select("id", "x").collect():
        record = np.array([[np.searchsorted(c, v, side="left") for c, v in zip(model.cuts, r.x)]], np.uint8)
        assert one[r.id] == pytest.approx(np.mean([share[T._leaves(words, record)[0]] for words, share in parts.values()]))


def test_rare_features_of_two_bins_share_a_place():
    """Rows of a node are split on them as on any other feature, in slices of nodes or at once."""
    rng = np.random.default_rng(8)
    n = 3000
    city, x = rng.integers(0, 20, n), rng.integers(0, 40, (2, n))
    bins = np.stack([*x, *[(city == i) for i in range(19)], rng.integers(0, 2, n)]).astype(np.uint8)
    labels = ((city % 3 == 0) ^ (x[0] > 25) ^ (rng.random(n) < 0.1)).astype(np.uint8)
    rows, col, code = T._records(bins, 5)
    assert rows.shape == (n, 4) and (code[2:21] > 0).all() and not code[[0, 1, 21]].any()
    grown = []
    for slice_rows in (T.SLICE, 64):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(T, "SLICE", slice_rows)
            grown.append(T.grow_part(bins, np.ones(n, int), labels, [0.7, 1.9], 22, 30, 40, np.random.default_rng(1)))
    (feature, cut, left, share), gains = grown[0]
    assert all((a == b).all() for a, b in zip([*grown[0][0], gains], [*grown[1][0], grown[1][1]]))
    assert (feature[0], cut[0]) == best_split(list(zip(bins.T.tolist(), labels.tolist())), [0.7, 1.9])[1:]
    leaf = T._walk(feature, cut, left, bins, np.zeros(n, np.int64))
    words, again = T._unpack_nodes(T._pack_nodes(feature, cut, left, share))
    assert (T._leaves(words, T._records_of(bins)) == leaf).all() and (again == share).all()
    for node in set(leaf.tolist()):
        n0, n1 = (w * int((labels[leaf == node] == k).sum()) for k, w in ((0, 0.7), (1, 1.9)))
        assert share[node] == pytest.approx(n1 / (n0 + n1))


def test_odd_rows(table):
    for labels in ([1], [0, 0, 0], [0, 1, 1, 1]):
        df = frame(table, [(i, [1.0], y) for i, y in enumerate(labels)])
        scored = T.fit_forest(df, "features", "y", [1.0, 1.0], 20, 5, 256, 1).score(df, "features").collect()
        assert len(scored) == len(labels) and len({r.probability_1 for r in scored}) == 1
        assert abs(scored[0].probability_1 - sum(labels) / len(labels)) < 0.25
    assert T.fit_forest(df, "features", "y", [1.0, 1.0], 2, 5, 256, 1).score(df.where("id < 0"), "features").count() == 0
    with pytest.raises(ValueError):
        T.fit_forest(df.where(F.lit(False)), "features", "y", [1.0, 1.0], 2, 5, 256, 1)


def test_copies_are_poisson():
    copies = T._copies(np.arange(100000), 3, 42)
    assert abs(copies.mean() - 1) < 0.02 and abs((copies == 0).mean() - np.exp(-1)) < 0.01
    assert (copies != T._copies(np.arange(100000), 4, 42)).mean() > 0.5
