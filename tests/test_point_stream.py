import json
import os

import pytest

from placewise import jobs
from placewise.sources import pages
from placewise.streaming import points


def line(point, page, status="OK", attempt=1, more=True, city="c"):
    results = [{"place_id": f"{city}{point}-{page}", "name": f"by attempt {attempt}"}] if status == "OK" else None
    payload = {"status": status, "next_page_token": "t" if more else None, "results": results}
    return json.dumps({"city": city, "point_no": point, "page_no": page, "attempt": attempt, "payload": payload})


@pytest.fixture
def crawl(spark, tmp_path):
    class Crawl:
        landed, log, checkpoint = (str(tmp_path / n) for n in ("landed", "log", "checkpoint"))
        n = 0

        def land(self, *lines, at):
            """A file of lines that lands ``at`` hours after the start; nothing reads it yet."""
            os.makedirs(self.landed, exist_ok=True)
            self.n += 1
            file = f"{self.landed}/{self.n}.json"
            with open(file, "w") as f:
                f.write("\n".join(lines) + "\n")
            os.utime(file, (1_700_000_000 + 3600 * at,) * 2)

        def step(self, *lines, at, **options):
            """A new query on the same checkpoint: each step is a restart."""
            self.land(*lines, at=at)
            points.start_points(points.read_page_stream(spark, self.landed), self.log, self.checkpoint,
                                **options).awaitTermination()

        def places(self):
            return sorted((r.place.place_id, r.place.name) for r in points.read_points(spark, self.log).collect())

        def batch_places(self):
            found = pages.read_search_pages(spark, self.landed)
            return sorted((r.place.place_id, r.place.name) for r in found.collect())

        def open(self):
            return sorted(tuple(r) for r in points.open_points(spark, self.log).collect())

    return Crawl()


def test_a_point_over_three_batches(crawl):
    crawl.step(line(1, 2, more=True), line(2, 1, more=False), at=0)
    assert crawl.places() == [("c2-1", "by attempt 1")] and crawl.open() == [("c", 1, "waiting", 1)]
    crawl.step(line(1, 1), at=1)
    assert crawl.open() == [("c", 1, "waiting", 2)]
    crawl.step(line(1, 3, more=False), at=2)
    assert [p for p, _ in crawl.places()] == ["c1-1", "c1-2", "c1-3", "c2-1"] and crawl.open() == []
    assert crawl.places() == crawl.batch_places()


def test_retries_replace_failed_attempts(crawl):
    crawl.step(line(1, 1), line(1, 2, "OVER_QUERY_LIMIT"), line(3, 1, "ZERO_RESULTS", more=False), at=0)
    crawl.step(line(1, 2, "UNKNOWN_ERROR", attempt=2), at=1)
    assert crawl.places() == [] and crawl.open() == [("c", 1, "waiting", 2)]
    crawl.step(line(1, 2, attempt=3, more=False), at=2)
    assert crawl.places() == [("c1-1", "by attempt 1"), ("c1-2", "by attempt 3")] == crawl.batch_places()


def test_attempts_in_the_wrong_order(crawl):
    crawl.step(line(1, 1, attempt=2, more=False), at=0)
    crawl.step(line(2, 1, attempt=2), at=1)
    crawl.step(line(2, 1, "UNKNOWN_ERROR", attempt=1), line(2, 2, more=False), at=2)  # an old failure lands late
    assert crawl.places() == [("c1-1", "by attempt 2"), ("c2-1", "by attempt 2"), ("c2-2", "by attempt 1")]


def test_pages_end_at_the_most(crawl):
    crawl.step(line(1, 1), line(1, 2), line(1, 3), line(1, 4), at=0)
    assert [p for p, _ in crawl.places()] == ["c1-1", "c1-2", "c1-3"]


def test_late_points_are_given_up(crawl):
    crawl.step(line(1, 1), at=0, patience="24 hours")
    crawl.step(line(2, 1), at=20, patience="24 hours")
    assert crawl.open() == [("c", 1, "waiting", 1), ("c", 2, "waiting", 1)]
    crawl.step(line(2, 2, more=False), line(3, 1), at=30, patience="24 hours")
    assert crawl.open() == [("c", 1, "given_up", 1), ("c", 3, "waiting", 1)]
    crawl.step(line(1, 2, more=False), at=31, patience="24 hours")  # too late: the first page is forgotten
    assert [p for p, _ in crawl.places()] == ["c2-1", "c2-2"]


@pytest.mark.parametrize("first", [True, False])
def test_unreadable_lines_cost_their_point(crawl, first):
    broken, good = '{"city": "c", "point_no": 1, "page_no": 2, "payl', line(1, 1, more=False)
    crawl.step(broken if first else good, line(2, 1, more=False), "{no point", at=0)
    crawl.step(good if first else broken, at=1)
    assert crawl.places() == [("c2-1", "by attempt 1")] == crawl.batch_places()


def test_a_replayed_batch_changes_nothing(spark, crawl):
    crawl.step(line(1, 1), at=0)
    crawl.step(line(1, 2, more=False), line(2, 1), at=1)
    before = crawl.places(), crawl.open()
    os.remove(f"{crawl.checkpoint}/commits/1")  # as after a crash between the write and the commit
    for crc in [f for f in os.listdir(f"{crawl.checkpoint}/commits") if f.startswith(".1")]:
        os.remove(f"{crawl.checkpoint}/commits/{crc}")
    points.start_points(points.read_page_stream(spark, crawl.landed), crawl.log, crawl.checkpoint).awaitTermination()
    assert (crawl.places(), crawl.open()) == before


def test_job(spark, crawl, tmp_path):
    crawl.land(line(1, 1), line(2, 1, more=False), at=0)
    out = [str(tmp_path / n) for n in ("one", "two")]
    run = lambda n, *more: jobs.run(spark, ["collect-stream", "--pages", crawl.landed, "--log", crawl.log,
                                            "--out", out[n], *more])
    run(0)
    assert [r.place_id for r in spark.read.parquet(out[0] + "/places").collect()] == ["c2-1"]
    crawl.land(line(1, 2, more=False), at=1)
    run(1, "--store", out[0] + "/places")
    assert sorted(r.place_id for r in spark.read.parquet(out[1] + "/places").collect()) == ["c1-1", "c1-2", "c2-1"]
    assert spark.read.parquet(out[1] + "/open_points").count() == 0
