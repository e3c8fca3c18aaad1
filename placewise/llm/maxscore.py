"""Exact top-k inner-product search with MaxScore.

Every dimension is a query term and its column of a shard the posting list, with the largest and smallest impact as
bounds. For each query the terms are split by their score bounds: the non-essential ones are those that together cannot
lift a vector above the k-th best score so far. Essential postings are traversed in blocks of vectors; the rest is probed,
strongest term first, only for vectors that can still compete. Blocks of queries meet shards of vectors; the best k of
each shard are merged.

Rows with a null id, a null vector, or a null or non-finite component take no part; shorter vectors are padded with
zeros. Every row counts: repeated rows are found once each and searched once each, and no query finds its own id. Equal
rows travel as one with their number, of which k can be in a result. Ties go to the smaller id. Quantised components
and scores beyond 64 bits are the nearest 64-bit integer, and rank as such. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.llm import common as C

SHARD_CELLS = 1 << 19  # components of a shard
QUERY_CELLS = 1 << 16  # components of a block of queries
BLOCK = 2048  # vectors traversed between two updates of the threshold
PROBE = 8  # non-essential terms probed between two checks
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # the limits of a score


class Shard:
    """Postings of some vectors: a row per dimension, vectors by ascending id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.high = np.maximum(self.postings.max(axis=1), 0)
        self.low = np.minimum(self.postings.min(axis=1), 0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors, best first."""
        bounds = np.maximum(query * self.high, query * self.low)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # what terms from here on can add
        ids, scores = np.empty(0, np.int64), np.empty(0, self.postings.dtype)
        threshold = None
        for at in range(0, len(self.ids), BLOCK):
            part = slice(at, at + BLOCK)
            essential = len(terms) if threshold is None else int(np.searchsorted(-rest, -threshold, side="left"))
            if threshold is not None and rest[0] <= threshold:
                break  # no vector of the shard can compete any more
            used = terms[:essential]
            partial = query[used] @ self.postings[used, part]
            at_hand = np.flatnonzero(self.ids[part] != query_id)
            partial = partial[at_hand]
            for t in range(essential, len(terms) + PROBE, PROBE):
                if threshold is not None:
                    alive = partial + rest[min(t, len(terms))] > threshold
                    at_hand, partial = at_hand[alive], partial[alive]
                if t >= len(terms) or not len(at_hand):
                    break
                probed = terms[t:t + PROBE]
                partial = partial + query[probed] @ self.postings[probed][:, part][:, at_hand]
            if partial.dtype == object:  # ids ascend, so a score cut to the limit cannot displace an earlier one
                partial = np.clip(partial, LEAST, MOST)
            ids, scores = np.concatenate((ids, self.ids[part][at_hand])), np.concatenate((scores, partial))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                threshold = scores[-1]
        return ids, scores


def exact_dtype(dims: int, *matrices: np.ndarray):
    """The fastest type in which inner products of whole numbers come out exactly."""
    bound = dims
    for m in matrices:
        bound *= max(int(m.max(initial=1)), -int(m.min(initial=-1)))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def stored_dtype(largest: int):
    """The smallest type that holds whole numbers up to ``largest`` on either side of zero."""
    return next((t for t in (np.int16, np.int32) if largest <= np.iinfo(t).max), np.int64)


def quantised(col: str, scale: int = 64) -> Column:
    """floor(scale * x) of every component, computed in double."""
    return F.transform(F.col(col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def topk_search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
                scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors for every row where ``is_query`` holds."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("raw"), is_query.alias("asks"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & fine).select(
        "id", quantised("raw", scale).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"), F.count("*").alias("n"))
    # -(x + 1) for a negative x: the smallest integer has no opposite
    sizes = F.array_max(F.transform("v", lambda x: F.when(x < 0, -(x + 1)).otherwise(x)))
    count, asked, dims, largest = rows.agg(
        F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(sizes), F.lit(0))).first()
    dims = max(dims, 1)
    n_shards = max(1, -(-count * dims // SHARD_CELLS))
    n_blocks = max(1, -(-asked * dims // QUERY_CELLS))
    small = stored_dtype(largest)
    packed = "part int, ids binary, copies binary, vectors binary"
    salt = F.xxhash64("id", "v")

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        matrix = np.zeros((table.num_rows, dims), small)
        matrix[np.repeat(np.arange(table.num_rows), lengths), C.ranges(lengths)] = lists.flatten().to_numpy()
        ids = table.column("id").to_numpy()
        order = np.lexsort((*matrix.T, ids))  # a recomputed block numbers its queries in the same way
        columns = {"ids": ids[order], "copies": table.column("n").to_numpy()[order], "vectors": matrix[order]}
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                         **{c: [x.tobytes()] for c, x in columns.items()}})

    def matrices(batch, side):
        ids, copies, vectors = (batch.column(side + c)[0].as_py() for c in ("ids", "copies", "vectors"))
        return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(vectors, small).reshape(-1, dims)

    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                cell = batch.slice(at, 1)
                q_ids, q_copies, queries = matrices(cell, "q_")
                ids, copies, vectors = matrices(cell, "")
                kind = exact_dtype(dims, queries, vectors)
                held = np.repeat(np.arange(len(ids)), np.minimum(copies, k))
                shard, out = Shard(ids[held], vectors[held].astype(kind)), []
                for no, (q_id, query) in enumerate(zip(q_ids.tolist(), queries.astype(kind))):
                    found, scores = shard.search(q_id, query, k)
                    out.append((np.full(len(found), q_id), np.full(len(found), no), np.full(len(found), q_copies[no]),
                                found, scores.astype(np.int64)))
                if out:
                    q, no, times, found, scores = (np.concatenate(x) for x in zip(*out))
                    part = np.full(len(q), cell.column("q_part")[0].as_py())
                    columns = {"query_id": q, "part": part, "no": no, "times": times, "vec_id": found, "score": scores}
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))

    shards = rows.withColumn("part", F.pmod(salt, F.lit(n_shards)).cast("int")).drop("asks")
    shards = shards.groupBy("part").applyInArrow(pack, packed)
    blocks = rows.where("asks").withColumn("part", F.pmod(salt, F.lit(n_blocks)).cast("int")).drop("asks")
    blocks = blocks.groupBy("part").applyInArrow(pack, packed)
    # every block of queries goes to every shard: the stated query set against all rows
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
                         *(F.col(c).alias("q_" + c) for c in ("part", "ids", "copies", "vectors")))
    cells = sent.repartition(4 * n_shards, "shard").join(shards, F.col("shard") == F.col("part"))
    best = cells.mapInArrow(search, "query_id long, part long, no long, times long, vec_id long, score long")
    order = Window.partitionBy("query_id", "part", "no").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return best.withColumn("copy", copies).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
