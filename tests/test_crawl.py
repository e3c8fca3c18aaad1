import math
import random

import pytest

from placewise import constants as K
from placewise.operators import crawl as C, grid as G


def corner(box):
    """Steps of a box by hand: rows, degrees between rows, and per row the number of points and degrees between them."""
    lat_min, lat_max, lng_min, lng_max, radius = box
    step = math.floor(radius * 1.2)
    height = step / 111320
    rows = math.floor((lat_max - lat_min) / height) + 1
    widths = [step / (111320 * math.cos(math.radians(lat_min + i * height)) + 1e-9) for i in range(rows)]
    return height, [(math.floor((lng_max - lng_min) / w) + 1, w) for w in widths]


@pytest.mark.parametrize("regions,want", [
    (K.PLATEAU_REGIONS, {"San Francisco": 196, "Los Angeles": 336, "Chicago": 702, "New York": 990}),
    (K.TARGET_REGIONS, {"San Francisco": 110, "Los Angeles": 192, "Chicago": 208, "New York": 154}),
])
def test_grid_points(spark, regions, want):
    grid = G.coverage_grid(G.regions_table(spark, regions)).collect()
    for name, *box in regions:
        points = sorted((r for r in grid if r["city"] == name), key=lambda r: r["point_no"])
        assert len(points) == want[name]
        assert [r["point_no"] for r in points] == list(range(1, len(points) + 1))
        height, rows = corner(box)
        assert [sum(p["row_no"] == i for p in points) for i in range(len(rows))] == [n for n, _ in rows]
        for p in points:
            assert p["lat"] == pytest.approx(box[0] + p["row_no"] * height, abs=1e-9)
            assert p["lng"] == pytest.approx(box[2] + p["col_no"] * rows[p["row_no"]][1], abs=1e-9)


def test_rows_beyond_a_pole_have_no_points(spark):
    """Numbers of columns that are below zero make no points, as in the SQL: counting down from 0 made some."""
    box = (80.0, 100.0, 10.0, 14.0, 20000)
    height, rows = corner(box)
    grid = G.coverage_grid(G.regions_table(spark, [("Pole", *box)])).collect()
    assert any(n <= 0 for n, _ in rows) and all(p["col_no"] >= 0 for p in grid)
    for i, (n, _) in enumerate(rows):
        before = sum(m for m, _ in rows[:i])
        assert sorted(p["point_no"] for p in grid if p["row_no"] == i) == list(range(before + 1, before + n + 1))


def expected_means(xs, window=50, warmup=80):
    """Mean of the last ``window`` numbers, of which those before the warm-up's end do not count once it is over."""
    first = [max(0, i - window + 1, warmup - 1 if i >= warmup - 1 else 0) for i in range(len(xs))]
    return [sum(xs[a:i + 1]) / (i + 1 - a) for i, a in enumerate(first)]


def expected_stop(xs, window=50, low=0.5, stable=5, warmup=80):
    """The first place (from 1) where ``stable`` full windows in a row, all after the warm-up, are below ``low``."""
    below = [i >= warmup + window - 2 and sum(xs[i - window + 1:i + 1]) < low * window for i in range(len(xs))]
    return next((i + 1 for i in range(len(xs)) if i + 1 >= stable and all(below[i + 1 - stable:i + 1])), None)


LOGS = {
    "zeros": [0] * 400, "ones": [1] * 400, "short": [0] * 132, "exact": [0] * 133, "tiny": [3, 0, 1],
    "mixed": [random.Random(5).choice([0, 0, 0, 1, 2]) for _ in range(700)],
    "late": [2] * 250 + [0] * 200, "gap": ([1, 0] * 60 + [0] * 30 + [9] + [0] * 200),
}


@pytest.mark.parametrize("block", [65_536, 64, 100])
def test_rolling_and_plateau(table, block):
    log = table("region string, point_no bigint, new_keys bigint",
                *[(name, i, n) for name, ns in LOGS.items() for i, n in enumerate(ns, 1)])
    rolled = {(r["region"], r["point_no"]): r["avg_new"] for r in C.rolling_yield(log, block=block).collect()}
    stops = {r["region"]: r["plateau_point"] for r in C.plateau_point(log, block=block).collect()}
    assert len(rolled) == sum(map(len, LOGS.values()))
    for name, ns in LOGS.items():
        assert [rolled[name, i] for i in range(1, len(ns) + 1)] == pytest.approx(expected_means(ns))
        assert stops[name] == expected_stop(ns)
    assert stops["zeros"] == 133 and stops["ones"] is None and stops["short"] is None and stops["exact"] == 133


def sightings(points, stored):
    """Point (from 1) and place of the first sighting of every key that the store lacks, in crawl order."""
    first = {}
    for p, results in reversed(list(enumerate(points, 1))):
        first.update({k: (p, i) for i, k in reversed(list(enumerate(results)))})
    return sorted((at, k) for k, at in first.items() if k and k not in stored)


@pytest.mark.parametrize("block", [65_536, 7])
def test_yield_and_cap(table, block):
    rng = random.Random(3)
    logs = {name: [[rng.choice([None, ""] + [f"k{i}" for i in range(60)]) for _ in range(rng.choice([0, 1, 5, 9]))]
                   for _ in range(40)] + [["last"]] for name in "xyz"}
    stored = {"x": {"k1", "k2"}, "y": set(), "z": {f"k{i}" for i in range(25)}}
    hits = table("region string, point bigint, pos int, key string",
                 *[(r, p, i, k) for r, points in logs.items() for p, ks in enumerate(points, 1) for i, k in enumerate(ks)])
    store = table("region string, key string", *[(r, k) for r, ks in stored.items() for k in ks])
    got = C.yield_per_point(hits, "region", "point", "key", existing=store, block=block).collect()
    for name, points in logs.items():
        news = [at for (at, _), _ in sightings(points, stored[name])]
        want = [(len(ks), news.count(p), len(stored[name]) + sum(n <= p for n in news)) for p, ks in enumerate(points, 1)]
        mine = sorted((r for r in got if r["region"] == name), key=lambda r: r["point_no"])
        assert [(r["got"], r["new_keys"], r["total"]) for r in mine] == want
    capped = C.cap_per_region(hits, "region", "point", "pos", "key", n=20, existing=store, block=block).collect()
    for name, points in logs.items():
        kept = [k for _, k in sightings(points, stored[name])][:max(0, 20 - len(stored[name]))]
        mine = sorted((r for r in capped if r["region"] == name), key=lambda r: (r["point"], r["pos"]))
        assert [r["key"] for r in mine] == kept


def test_last_point_without_results(table):
    hits = table("region string, point bigint, key string", ("x", 2, "a"))
    ends = table("region string, point bigint", ("x", 4), ("empty", 3))
    got = C.yield_per_point(hits, "region", "point", "key", last_point=ends).collect()
    assert sorted((r["region"], r["point_no"], r["total"]) for r in got) == [
        ("empty", 1, 0), ("empty", 2, 0), ("empty", 3, 0), ("x", 1, 0), ("x", 2, 1), ("x", 3, 1), ("x", 4, 1)]


def test_region_counts(table, as_rows):
    df = table("city string", ("a",), ("a",), ("b",), (None,))
    assert as_rows(C.region_counts(df, "city", 2)) == [("a", 2, True), ("b", 1, False)]
