"""``[[name, ...], [value, ...], ...]`` files, cut at their rows so that one large document is read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such files: ``file``, ``text`` (one JSON array), and whether it is the ``first`` of its file.

    Files are read in byte ranges as pieces that end at ``]``. Such a bracket closes a row only outside of strings and
    at the depth of rows, which depends on all brackets and quotes before it. Each range is counted on its own, for both
    answers to whether it begins inside a string: its quotes, how deep its brackets lead, and how many pieces end at each
    depth. One row a range settles the ranges in the order of the file. A piece that is a row stays where it is; only
    rows with a bracket in a value, or with a nested value, are put together, also across ranges.

    A file that does not close its brackets, or holds anything beside rows, fails the query. An empty file, and ``[]``,
    have no rows.
    """
    part = ["file", "block"]
    pieces = spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"), F.col("value").alias("text"))  # ascends inside a range
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    strings = '"[^"]*"?'
    pieces = pieces.withColumns({
        "odd": (F.length(bare) - F.length(F.translate(bare, '"', ""))) % 2,
        "from_outside": _deeper(F.regexp_replace(bare, strings, "")),
        "from_inside": _deeper(F.regexp_replace(F.regexp_replace(bare, '^[^"]*"?', ""), strings, ""))})
    # the bracket that ends a piece counts unless it belongs to a string
    pieces = pieces.withColumns({"from_outside": F.col("from_outside") - 1 + F.col("odd"),
                                 "from_inside": F.col("from_inside") - F.col("odd")})
    order = Window.partitionBy(*part).orderBy("piece")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("before", (F.sum("odd").over(so_far) - F.col("odd")) % 2)
    like, unlike = F.col("before") == 0, F.col("before") == 1
    pieces = pieces.withColumns({"step0": F.when(like, F.col("from_outside")).otherwise(F.col("from_inside")),
                                 "step1": F.when(unlike, F.col("from_outside")).otherwise(F.col("from_inside"))})
    pieces = pieces.withColumns({"run0": F.sum("step0").over(so_far), "run1": F.sum("step1").over(so_far)})

    # a piece ends outside of strings for one of the two answers
    answer = (F.col("before") + F.col("odd")) % 2
    counts = pieces.groupBy(*part, answer.alias("answer"), F.when(answer == 0, F.col("run0")).otherwise(F.col("run1")).alias("run")
                            ).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("odd", "step0", "step1")])
    ranges = counts.groupBy(*part).agg(
        (F.sum("odd") % 2).alias("parity"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"),
        F.collect_list(F.struct("answer", "run", "n")).alias("ends"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("step", F.when(F.col("inside") == 0, F.col("step0")).otherwise(F.col("step1")))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("step").over(earlier), F.lit(0)))
    rows = F.filter("ends", lambda e: (e["answer"] == F.col("inside")) & (e["run"] == 1 - F.col("depth")))
    ranges = ranges.withColumn("rows", F.coalesce(F.get(rows, F.lit(0))["n"], F.lit(0)))
    whole = Window.partitionBy("file")
    # white space after the last bracket counts as one more piece
    closed = (F.sum("parity").over(whole) % 2 == 0) & F.sum("step").over(whole).between(-1, 0)
    ranges = ranges.select(
        *part, "inside", "depth", closed.alias("closed"),
        F.last(F.when(F.col("rows") > 0, F.struct("block", F.col("rows").alias("row"))), True).over(earlier).alias("owner"))

    settled = F.col("inside") == 0
    pieces = pieces.join(ranges, part).withColumns({
        "after": F.col("depth") + F.when(settled, F.col("run0")).otherwise(F.col("run1")),
        "step": F.when(settled, F.col("step0")).otherwise(F.col("step1")),
        "begins": (F.col("before") + F.col("inside")) % 2 == 0, "ends": answer == F.col("inside")})
    pieces = pieces.withColumn("closes", F.col("ends") & (F.col("after") == 1))
    pieces = pieces.withColumn("row", F.count_if("closes").over(so_far) - F.col("closes").cast("long"))
    # pieces ahead of the first end of a row in a range belong to the row that the nearest range with one left open
    here = (F.col("row") > 0) | (F.col("block") == 0)
    start = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    pieces = pieces.withColumn("key", F.when(here, F.struct("block", "row")).otherwise(F.coalesce("owner", start)))
    depth = F.col("after") - F.col("step")
    frame = F.col("begins") & F.col("ends") & (F.col("after") <= 0)
    blank = F.col("text").rlike(r"^\s*$") | ((depth == 0) & F.col("text").rlike(r"^\s*\[\s*$"))
    fault = F.when(~F.col("closed"), "a document does not close: ").when(frame & ~blank, "text beside the rows: ")
    pieces = pieces.where(F.when(fault.isNotNull(), F.raise_error(F.concat(fault, "file")).cast("boolean")).otherwise(~frame))

    first = (F.col("key") == start).alias("first")
    alone = F.col("begins") & F.col("closes") & ((depth == 1) | ((depth == 0) & first))
    several = pieces.where(~alone).groupBy("file", "key").agg(
        F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("pieces"))
    several = several.select("file", F.array_join(F.col("pieces.text"), "]").alias("text"), first)
    text = F.concat(F.regexp_replace("text", r"^\s*[\[,](?=\s*\[)", ""), F.lit("]"))
    joined = F.col("text").rlike(r"^\s*\[\s*\[") == F.col("first")  # a comma between rows, none ahead of the first
    wrong = F.raise_error(F.concat(F.lit("not a row: "), "text")).cast("string")
    rows = pieces.where(alone).select("file", "text", first).unionByName(several)
    return rows.withColumn("text", F.when(joined & F.col("text").rlike(r"^\s*[\[,]\s*\["), text).otherwise(wrong))


def _deeper(code: Column) -> Column:
    """How many more brackets open than close in a text without strings."""
    return F.length(F.translate(code, "}", "")) - F.length(F.translate(code, "[{", ""))


def read_split(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of such files as text. They are looked up in the first row of each file."""
    values = F.from_json("text", "array<string>")
    broken = F.raise_error(F.concat(F.lit("not a row: "), "text")).cast("array<string>")
    rows = json_rows(spark, path).select("file", "first", F.coalesce(values, broken).alias("row"))
    headers = rows.where("first").select("file", column_places(F.col("row"), columns).alias("at"))
    table = rows.where("not first").join(headers, "file")
    return table.select(*[F.get("row", F.get("at", F.lit(i))).alias(name) for i, name in enumerate(columns)])


def column_places(header: Column, columns: list[str]) -> Column:
    """Where the columns stand in a header, from 0; a missing one fails the query."""
    places = []
    for name in columns:
        at = F.array_position(header, name)
        missing = F.raise_error(F.lit(f"the header has no column {name}")).cast("int")
        places.append(F.when(at > 0, (at - 1).cast("int")).otherwise(missing))
    return F.array(*places)
