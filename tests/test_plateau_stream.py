import random

import pytest

from placewise.operators import crawl as C
from placewise.streaming import ingest, plateau as P

RULE = dict(window=4, min_new_avg=0.5, stable=2, warmup=3)
SCHEMA = "region string, point_no bigint, key string"


@pytest.fixture
def crawl(spark, tmp_path):
    class Crawl:
        landed, log, checkpoint = (str(tmp_path / n) for n in ("landed", "log", "checkpoint"))
        rows, existing = [], None

        def step(self, *rows):
            """Some results land; a new query on the same checkpoint counts them."""
            self.rows = self.rows + list(rows)
            spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(self.landed)
            P.start_yield(ingest.read_stream(spark, self.landed, SCHEMA), self.log, self.checkpoint, "region", "point_no",
                          "key", self.existing, **RULE).awaitTermination()

        def plateaus(self, closed=False):
            return dict(tuple(r) for r in P.read_plateaus(spark, self.log, closed, **RULE).collect())

        def batch_yield(self):
            return C.yield_per_point(spark.createDataFrame(self.rows, SCHEMA), "region", "point_no", "key", self.existing)

        def batch_plateaus(self):
            return dict(tuple(r) for r in C.plateau_point(self.batch_yield(), **RULE).collect())

        def stops(self):
            return sorted(tuple(r) for r in P._read(spark, self.log, "stops", P.STOPS).collect())

    return Crawl()


def test_a_plateau_across_batches_is_told_once(crawl):
    crawl.step(*[("a", p, f"k{p}") for p in range(1, 5)], ("b", 1, "x"))
    assert crawl.plateaus() == {"a": None, "b": None}
    crawl.step(*[("a", p, "k1") for p in range(5, 8)])  # windows from point 3 on: 3-6 and 4-7 hold two and one new keys
    crawl.step(("a", 8, "k1"), ("b", 2, "x"))
    assert crawl.plateaus() == {"a": None, "b": None}  # point 8 may go on
    assert crawl.plateaus(closed=True) == {"a": 8, "b": None} == crawl.batch_plateaus()
    crawl.step(("a", 9, "new"), ("b", 3, "y"))
    assert crawl.plateaus() == {"a": 8, "b": None} and crawl.stops() == [("a", 8, 3)]
    crawl.step(("a", 10, "more"), ("b", 20, "y"))
    assert crawl.stops() == [("a", 8, 3), ("b", 7, 4)]  # windows 3-6 and 4-7 hold y alone
    assert crawl.plateaus(closed=True) == crawl.batch_plateaus()


def test_a_point_cut_by_a_batch_is_counted_whole(spark, crawl, as_rows):
    crawl.existing = spark.createDataFrame([("a", "k1"), ("a", ""), ("a", None), ("z", "q")], "region string, key string")
    crawl.step(("a", 1, "k1"), ("a", 2, "k2"), ("a", 2, None), ("a", 4, ""), (None, 3, "n"))
    crawl.step(("a", 4, "k3"), ("a", 4, "k2"), ("a", 5, "k4"), ("c", 2, "k2"))
    crawl.step(("a", 5, "k4"), ("a", 5, "k5"))
    order = ("region", "point_no", "got", "new_keys", "total")
    got = P.read_yield(spark, crawl.log, crawl.existing)
    assert as_rows(got, *order) == as_rows(crawl.batch_yield(), *order)


def test_random_crawls_equal_the_batch_rule(crawl):
    r = random.Random(5)
    rows = {c: sorted(((c, p, f"k{r.randrange(1 + n)}") for p in r.sample(range(1, 60), 40)), key=lambda x: x[1])
            for n, c in ((3, "a"), (15, "b"), (60, "c"), (5000, "d"))}
    at = 0
    for size in (7, 1, 12, 9, 11):
        crawl.step(*[x for found in rows.values() for x in found[at:at + size]])
        at += size
    assert at == 40 and crawl.plateaus(closed=True) == crawl.batch_plateaus()
    stops = crawl.stops()
    assert len({s[0] for s in stops}) == len(stops)


def test_a_replayed_batch_changes_nothing(spark, crawl, as_rows, tmp_path):
    crawl.step(*[("a", p, f"k{p}") for p in range(1, 6)])
    crawl.step(*[("a", p, "k1") for p in range(6, 12)])
    want = as_rows(P.read_yield(spark, crawl.log)), crawl.stops(), crawl.plateaus(closed=True)
    for commit in (tmp_path / "checkpoint" / "commits").glob("*1*"):  # as if the last batch had crashed when it was done
        commit.unlink()
    P.start_yield(ingest.read_stream(spark, crawl.landed, SCHEMA), crawl.log, crawl.checkpoint, "region", "point_no", "key",
                  **RULE).awaitTermination()
    assert (as_rows(P.read_yield(spark, crawl.log)), crawl.stops(), crawl.plateaus(closed=True)) == want
