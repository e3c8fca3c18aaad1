"""Parquet, CSV, JSON and header-plus-rows JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from placewise.sources.json_rows import column_places, read_split


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header. Quotes inside a field are doubled, as in JSON text columns. Large files are split.

    Fields may hold line breaks (``\\n`` ends a line, ``\\r`` before it is cut off at the end of a record), unless
    ``multi_line=False``, which saves a shuffle. A file whose header is not ``schema`` fails the query.
    """
    if multi_line:
        df = spark.createDataFrame([], schema)
        df = _parsed(csv_records(spark, path), schema, df.columns)
    else:
        df = (spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path))
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles})


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, ``text``, and whether one is the ``first`` of its file.

    Whether a line begins a record depends on the number of quotes before it in its file: even outside of fields. Byte
    ranges of a file are read in parallel and each is counted on its own: its quotes, odd or even, and how many records
    begin in it for either answer to how it itself begins. One row a range settles the ranges in the order of the file.
    A line with an even number of quotes that begins a record is the record; only the other lines are put together,
    also across ranges.
    """
    part = ["file", "block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))  # ascends inside a range
    lines = lines.withColumn("odd", (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2)
    order = Window.partitionBy(*part).orderBy("line")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("before", before % 2)
    ranges = lines.groupBy(*part).agg(
        (F.sum("odd") % 2).alias("parity"), F.count_if(F.col("before") == 0).alias("starts_outside"),
        F.count_if(F.col("before") == 1).alias("starts_inside"))
    file_order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("parity").over(file_order), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 0, F.col("starts_outside")).otherwise(F.col("starts_inside"))
    ranges = ranges.withColumn("owner", F.last(F.when(starts > 0, F.struct("block", starts.alias("record"))), True)
                               .over(file_order)).select(*part, "inside", "owner")
    lines = lines.join(ranges, part).withColumn("begins", F.col("before") == F.col("inside"))
    record = F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # lines ahead of the first record of a range belong to the last record of the nearest range that has one
    lines = lines.withColumn("record", record).withColumn(
        "key", F.when(F.col("record") > 0, F.struct("block", "record")).otherwise(F.col("owner")))
    first = ((F.col("key.block") == 0) & (F.col("key.record") == 1)).alias("first")
    alone = F.col("begins") & (F.col("odd") == 0)
    several = lines.where(~alone).groupBy("file", "key").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("lines"))
    several = several.select(F.array_join(F.col("lines.text"), "\n").alias("text"), first)
    return lines.where(alone).select("text", first).unionByName(several)


def _parsed(records: DataFrame, schema: str, names: list[str]) -> DataFrame:
    text = F.regexp_replace("text", "\r$", "")
    options = {"escape": '"', "multiLine": "true"}
    header = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(names) + 1)), options)
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.coalesce(F.lower(header[f"c{i}"]) == name.lower(), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("a CSV header is not the schema: "), text)).cast("boolean")
    same = same & header[f"c{len(names)}"].isNull()
    rows = records.where(F.when(F.col("first"), F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.length(text) > 0))
    return rows.select(F.from_csv(text, schema, options).alias("row")).select("row.*")


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the Parquet table at ``path`` and return it as read back; also cuts the lineage.

    The new table is written beside the old one, which goes only when the new one is whole: a job that fails leaves the
    old table as it was, and the query may read the table it replaces.
    """
    path = path.rstrip("/")
    fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        writer.parquet(fresh)
    except Exception:
        files.delete(jvm.Path(fresh), True)
        raise
    there = files.exists(jvm.Path(path))
    if there:
        files.rename(jvm.Path(path), jvm.Path(old))
    if not files.rename(jvm.Path(fresh), jvm.Path(path)):
        if there:
            files.rename(jvm.Path(old), jvm.Path(path))
        raise OSError(f"cannot move the new table to {path}")
    if there:
        files.delete(jvm.Path(old), True)
    return spark.read.schema(df.schema).parquet(path)


def read_header_rows_json(spark: SparkSession, path: str, columns: list[str], whole_file: bool = True) -> DataFrame:
    """``[[name, ...], [value, ...], ...]`` documents to a table of text columns.

    ``columns`` are looked up in each document's own first row; a document that lacks one fails the query.
    A document is a file (API answers are landed one per file), read in ranges however large it is, or, with
    ``whole_file=False``, a line.
    """
    if whole_file:
        return read_split(spark, path, columns)
    return header_rows(spark.read.text(path), "value", columns)


def header_rows(df: DataFrame, col: str, columns: list[str]) -> DataFrame:
    table = df.select(F.from_json(F.col(col), "array<array<string>>").alias("t")).where("t is not null")
    at = column_places(F.get("t", F.lit(0)), columns)
    rows = table.select(at.alias("at"), F.posexplode("t").alias("row_no", "row")).where("row_no > 0")
    return rows.select(*[F.get("row", F.get("at", F.lit(i))).alias(name) for i, name in enumerate(columns)])
