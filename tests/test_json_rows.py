import json
import random

import pytest

from placewise.sources import tables
from placewise.sources.json_rows import json_rows

COLUMNS = ["c", "a"]


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def read(spark, path, columns=COLUMNS):
    return sorted((tuple(r) for r in tables.read_header_rows_json(spark, str(path), columns).collect()), key=str)


VALUES = ["plain", "", None, "a]b", '"], ["', "[[", "back\\", '\\"]', "]" * 30, "two\nlines", "é漢🙂", "x" * 300, "}{", "\\\\]", '"']


@pytest.mark.parametrize("size, indent", [(64, None), (300, 1), (1 << 20, 1)])
def test_as_the_json_module(spark, tmp_path, small_ranges, size, indent):
    rng = random.Random(size)
    want = []
    for name in "xyz":
        header = rng.sample(["a", "b]", 'c"'] if name == "z" else ["a", "b", "c"], 3)
        rows = [[rng.choice(VALUES) for _ in header] for _ in range(25)]
        (tmp_path / f"{name}.json").write_text(
            json.dumps([header, *rows], indent=indent, ensure_ascii=rng.random() < 0.5) + "\n" * rng.randrange(2), encoding="utf-8")
        want += [(name, r[header.index("a")]) for r in rows]
    small_ranges(size)
    assert read(spark, tmp_path, ["a"]) == sorted(((v,) for _, v in want), key=str)
    assert json_rows(spark, str(tmp_path)).where("first").count() == 3


@pytest.mark.parametrize("size", [12, 1 << 20])
def test_by_hand(spark, tmp_path, small_ranges, size):
    (tmp_path / "1.json").write_text(' [ ["a", "b", "c"] ,\n[1, [2, ["]"]], {"k": ["x", "}"]}], [true, null, -1.5]\n] \n')
    (tmp_path / "2.json").write_text('[["c","a"],["only"],[]]')
    (tmp_path / "3.json").write_text("[]")
    (tmp_path / "4.json").write_text("")
    (tmp_path / "5.json").write_text('[["c","a"]]\n')
    small_ranges(size)
    assert read(spark, tmp_path) == sorted(
        [('{"k":["x","}"]}', "1"), ("-1.5", "true"), ("only", None), (None, None)], key=str)


@pytest.mark.parametrize("text", [
    '[["c","a"],["1","2"]', '[["c","a"],["1","2"', '[["c","a"],["1","2', '<html>"]</html>', '{"error": "no"}', '{"error": ["no"]}',
    '[["c","a"]["1","2"]]', '[["c","a"],null,["1","2"]]', '[["c","a"],["1",}]]', '[["c","a"],["1","2"]] more', "null", '["c","a"]'])
def test_what_is_not_rows_fails(spark, tmp_path, small_ranges, text):
    (tmp_path / "x.json").write_text(text)
    small_ranges(10)
    with pytest.raises(Exception, match="not a row|does not close|beside the rows"):
        read(spark, tmp_path)


def test_one_document_is_many_tasks(spark, tmp_path, small_ranges):
    rows = [[str(i), "v]" * (i % 3)] for i in range(2000)]
    (tmp_path / "x.json").write_text(json.dumps([["a", "c"], *rows]))
    small_ranges(2000)
    df = tables.read_header_rows_json(spark, str(tmp_path), COLUMNS)
    assert spark.read.option("lineSep", "]").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert "wholetext" not in df._jdf.queryExecution().toString().lower()
    assert sorted(int(r["a"]) for r in df.collect()) == list(range(2000))
    assert df.where("c = repeat('v]', cast(a as int) % 3)").count() == 2000
