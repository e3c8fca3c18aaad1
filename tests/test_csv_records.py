import random

import pytest

from placewise.sources import tables

SCHEMA = "id bigint, a string, b double, c string"


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def own_reader(spark, path):
    """Spark's multi-line reader: one task a file."""
    return (spark.read.schema(SCHEMA).option("header", True).option("escape", '"').option("multiLine", True)
            .option("enforceSchema", False).csv(path))


def same(spark, path):
    got, want = ([tuple(r) for r in df.collect()] for df in (tables.read_csv(spark, path, SCHEMA), own_reader(spark, path)))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


TEXTS = ['plain', 'two\nlines', 'a "quoted" word', '"', '""', '\n', '\n\n"\n', 'x,y', '', None, 'é\r\n漢', 'say ""\n"" twice,\n', ' pad ',
         "long " * 60 + "\n" + "more " * 60, '"\n"']


@pytest.mark.parametrize("size", [16, 100, 1000, 1 << 20])
def test_as_the_whole_file_reader(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    rows = [(i, rng.choice(TEXTS), rng.choice([None, 1.5, -2.0]), rng.choice(TEXTS)) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    tables.write_csv(df, str(tmp_path / "t"))
    small_ranges(size)
    got = same(spark, str(tmp_path / "t"))
    assert sorted(got) == [tuple(x if x != "" else None for x in r) for r in rows]  # no text is null, as in the file
    ranges = tables.csv_records(spark, str(tmp_path / "t"))
    assert ranges.where("first").count() == 2


def test_by_hand(spark, tmp_path, small_ranges):
    path = str(tmp_path / "x.csv")
    with open(path, "w", newline="") as f:
        f.write('id,a,b,c\r\n1,"one\r\ntwo",1.5,x\r\n\r\n2,"""",,"a\n\n\n""b"""\r\n3,"' + "line\n" * 50 + '",NaN,"end, of ""it"""')
    for size in (8, 40, 1 << 20):
        small_ranges(size)
        got = sorted(tuple(r) for r in tables.read_csv(spark, path, SCHEMA).collect())
        assert got == [(1, "one\r\ntwo", 1.5, "x"), (2, '"', None, 'a\n\n\n"b"'), (3, "line\n" * 50, None, 'end, of "it"')]


def test_one_file_is_many_tasks(spark, tmp_path, small_ranges):
    rows = [(i, "a\nb" * 20, 0.5, 'c"c') for i in range(2000)]
    tables.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "t"))
    small_ranges(10_000)
    df = tables.csv_records(spark, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 10
    assert "multiLine" not in df._jdf.queryExecution().toString() and df.count() == 2001
    assert tables.read_csv(spark, str(tmp_path / "t"), SCHEMA).where("a = repeat('a\nb', 20)").count() == 2000


def test_wrong_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,a,c,b\n1,2,3,4\n")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()


def test_empty(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,a,b,c\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect() == []
    (tmp_path / "x.csv").write_text("")
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect() == []
