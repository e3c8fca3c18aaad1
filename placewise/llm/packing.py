"""Packing by optimal length buckets.

The global histogram of lengths goes to the driver, where dynamic programming chooses the bucket boundaries with the least
padding. Different lengths add up to the corpus's words at most, so 30 GB of text have some 100,000 of them. Only beyond
``MOST_LENGTHS``, which takes 500 billion words, do lengths above ``EXACT`` share classes; the padding is then above the least
by 1/128 of the words at most. Inside each bucket, batches take as many documents as
the token budget allows at the bucket's padded length.

A length is the number of words (runs of bytes other than ASCII white space); null and empty texts have length 0 and are
packed like any other. Every row of the table is in one batch, repeated rows included; a document longer than the budget
is a batch of its own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.llm import common as C
from placewise.session import stage

BUDGET = 16_384  # tokens of a batch, padding included
BUCKETS = 16
MOST_LENGTHS = 1 << 20  # different lengths that go to the driver
EXACT = 1024  # in a longer histogram, lengths up to here are classes of their own; beyond, a class spans 1/128 of its length
SLICE = 50_000  # documents numbered by one task


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens."""
    def one(batch):
        data, offsets = C.text_buffer(batch.column("text"))
        _, _, row = C.split_words(data, offsets)
        return {"doc_id": batch.column("doc_id"), "n_tokens": C.per_row(row, len(offsets) - 1)}

    return C.per_chunk(C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col), "doc_id long, n_tokens long", one)


def length_class(n: Column) -> Column:
    """Ascending with the length; about 128 classes per doubling beyond ``EXACT``, so some thousands for any corpus."""
    doubling = F.length(F.bin(n)) - 1
    coarse = doubling * 128 + F.floor(n / F.pow(F.lit(2.0), doubling - 7)).cast("long")
    return F.when(n <= EXACT, n).otherwise(coarse + EXACT)


def best_boundaries(longest: np.ndarray, count: np.ndarray, tokens: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Padded lengths of at most ``buckets`` buckets with the least padding, and that padding.

    ``longest``, ``count`` and ``tokens`` describe length classes in ascending order; a bucket ends at the longest
    document of a class. The dynamic programme goes over (buckets used, classes covered).
    """
    n = len(longest)
    docs = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    held = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    worst = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, worst)
    cost[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        after, choice = np.full(n + 1, worst), np.zeros(n + 1, np.int64)
        after[0] = 0
        # the first class of the last bucket, i, never falls as the classes covered, j, grow: after every second j of a
        # step, those between need only look between their neighbours' i
        step = 1 << n.bit_length()
        while step:
            j = np.arange(step, n + 1, 2 * step)
            low = choice[j - step]
            high = np.minimum(np.where(j + step <= n, choice[np.minimum(j + step, n)], n), j - 1)
            size = high - low + 1
            first = np.cumsum(size) - size
            i, to = C.ranges(size) + np.repeat(low, size), np.repeat(j, size)
            total = cost[i] + longest[to - 1] * (docs[to] - docs[i]) - (held[to] - held[i])
            if len(j):
                after[j] = np.minimum.reduceat(total, first)
                at = np.flatnonzero(total == np.repeat(after[j], size))
                choice[j] = i[at[np.searchsorted(at, first)]]
            step //= 2
        choices.append(choice)
        cost = after
    ends, j = [], n
    for choice in reversed(choices):
        if j:
            ends.append(int(longest[j - 1]))
            j = int(choice[j])
    return ends[::-1], int(cost[n])


def pack_batches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET,
                 buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_len (padded length), batch (from 0 in each bucket), padding."""
    # the number that deals documents out is written with the lengths: a repeated id cannot crowd a slice,
    # and a task that runs again reads what it read before
    dealt = word_counts(df, id_col, text_col).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id()))
    lengths = stage(dealt, "lengths")
    def histogram(by):
        return lengths.groupBy(by.alias("class")).agg(
            F.max("n_tokens").alias("longest"), F.count("*").alias("count"), F.sum("n_tokens").alias("tokens"))

    found = histogram(F.col("n_tokens")).limit(MOST_LENGTHS + 1).toArrow()
    if found.num_rows > MOST_LENGTHS:
        found = histogram(length_class(F.col("n_tokens"))).toArrow()
    if not found.num_rows:
        return lengths.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"),
                              F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("padding"))
    found = found.sort_by("longest")
    longest, count, tokens = (found.column(c).to_numpy().astype(np.int64) for c in ("longest", "count", "tokens"))
    ends, _ = best_boundaries(longest, count, tokens, buckets)
    sizes = np.bincount(np.searchsorted(ends, longest), weights=count, minlength=len(ends))
    slices = [int(-(-s // SLICE)) or 1 for s in sizes]

    def listed(values, at):
        return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), at + 1)

    bucket = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e < F.col("n_tokens")))
    rows = lengths.withColumn("bucket", bucket)
    rows = rows.withColumn("slice", F.pmod(F.col("dealt"), listed(slices, F.col("bucket"))))
    sums = rows.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("bucket", "slice").orderBy("dealt", "doc_id", "n_tokens")
    number = F.col("begin") + F.row_number().over(inside) - 1
    fit = listed([max(1, budget // max(e, 1)) for e in ends], F.col("bucket"))
    return rows.join(begins, ["bucket", "slice"]).withColumn("number", number).select(
        "doc_id", "n_tokens", "bucket", listed(ends, F.col("bucket")).alias("bucket_len"),
        F.floor(F.col("number") / fit).alias("batch"),
        (listed(ends, F.col("bucket")) - F.col("n_tokens")).alias("padding"))
