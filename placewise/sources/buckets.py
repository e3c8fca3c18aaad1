"""Tables in hash buckets of their key, in which an upsert reads and rewrites only the buckets that its batch touches.

A bucket is a partition of an external table that is also bucketed by Spark, with the same hash: partition ``_bucket=b``
holds bucket ``b`` and nothing else. So a join on the key reads the table in place, without an exchange of its rows, and
a partition filter on the batch's buckets prunes the rest.

A write never overwrites a file. The new rows of the touched buckets go to a folder of their own, and then each bucket's
partition is pointed to it: a job that fails leaves every bucket as it was, and one that fails between two buckets is
put right by running the same batch again. Superseded folders stay until ``drop_superseded``, so running readers
keep what they have planned to read. One writer at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.operators.keyed import insert_new, upsert

BUCKET = "_bucket"


def bucket_of(keys: list[str], n: int) -> Column:
    """The bucket Spark itself puts a row in."""
    return F.pmod(F.hash(*keys), F.lit(n)).cast("int")


def create_buckets(df: DataFrame, name: str, path: str, keys: list[str], n: int) -> DataFrame:
    """A new table of ``n`` buckets with the rows of ``df``. Choose ``n`` so that a bucket fits a task at the size the
    table will grow to (some 128 MB to 1 GB); it cannot be changed later. Null keys are rows like others."""
    _write(df, name, f"{path.rstrip('/')}/{uuid.uuid4().hex}", keys, n)
    return read_buckets(df.sparkSession, name)


def read_buckets(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(BUCKET)


def upsert_buckets(spark: SparkSession, name: str, path: str, batch: DataFrame, keys: list[str], n: int,
                   update_cols: list[str], order_cols: list, touch: dict[str, Column] | None = None) -> list[int]:
    """``keyed.upsert`` of ``batch`` into the table; returns the buckets that were rewritten."""
    return _apply(spark, name, path, batch, keys, n,
                  lambda old, new: upsert(old, new, keys, update_cols, order_cols, touch))


def insert_buckets(spark: SparkSession, name: str, path: str, batch: DataFrame, keys: list[str], n: int,
                   order_cols: list, touch: dict[str, Column] | None = None) -> list[int]:
    """``keyed.insert_new`` of ``batch`` into the table; returns the buckets that were rewritten."""
    return _apply(spark, name, path, batch, keys, n, lambda old, new: insert_new(old, new, keys, order_cols, touch))


def touched_rows(spark: SparkSession, name: str, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; the scan prunes the others."""
    return spark.table(name).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)


def drop_superseded(spark: SparkSession, name: str, path: str) -> int:
    """Deletes the buckets' folders that the table no longer points to; returns how many. Not while a write runs."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    live = {files.makeQualified(jvm.Path(place)).toString() for place in _locations(spark, name).values()}
    old = [f.getPath() for f in files.globStatus(jvm.Path(root, f"*/{BUCKET}=*"))]
    old = [folder for folder in old if folder.toString() not in live]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def _apply(spark: SparkSession, name: str, path: str, batch: DataFrame, keys: list[str], n: int, merge) -> list[int]:
    old = read_buckets(spark, name)
    # a key of another type has another hash
    batch = batch.withColumns({k: F.col(k).cast(old.schema[k].dataType) for k in keys})
    found = batch.select(bucket_of(keys, n).alias(BUCKET)).distinct().collect()  # at most n rows
    buckets = sorted(r[0] for r in found)
    if not buckets:
        return []
    fresh, place = f"{name}_{uuid.uuid4().hex}", f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    _write(merge(touched_rows(spark, name, buckets), batch).select(*old.columns), fresh, place, keys, n)
    try:
        _repoint(spark, name, fresh)
    finally:
        spark.sql(f"drop table {fresh}")  # external: its files stay
    return buckets


def _write(df: DataFrame, name: str, place: str, keys: list[str], n: int) -> None:
    rows = df.withColumn(BUCKET, bucket_of(keys, n)).repartition(n, *keys)
    (rows.write.format("parquet").partitionBy(BUCKET).bucketBy(n, *keys).sortBy(*keys).option("path", place)
     .saveAsTable(name))


def _locations(spark: SparkSession, name: str) -> dict[int, str]:
    """Where each bucket lies: at most as many rows as buckets."""
    files = spark.table(name).select(BUCKET, "_metadata.file_path").distinct()
    return {b: unquote(path).rsplit("/", 1)[0] for b, path in files.collect()}


def _repoint(spark: SparkSession, name: str, fresh: str) -> None:
    known = {r[0].split("=")[1] for r in spark.sql(f"show partitions {name}").collect()}
    for b, place in _locations(spark, fresh).items():
        place = place.replace("'", "\\'")
        if str(b) in known:
            spark.sql(f"alter table {name} partition ({BUCKET}={b}) set location '{place}'")
        else:
            spark.sql(f"alter table {name} add partition ({BUCKET}={b}) location '{place}'")
    spark.catalog.refreshTable(name)
