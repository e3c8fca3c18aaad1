"""Audit of how the sources of a language differ: which sources use words unlike which others, and which words stand out.

A group is a (lang, source). Each language keeps the terms that at least ``MIN_DOCS`` of its documents hold; a group or
a whole language gives a kept term with ``count`` occurrences the price p = 1 + floor(10^9 (count + 1) / (N + V)), where N
sums the counts and V is the number of kept terms. A term costs f = floor((p - q)^2 / q) against another price q.

* Part ``pair`` adds f over all kept terms for each other source of the language. The addends depend on the two counts
  alone, so they come from joint tables: for every group and count level there is an indicator column over the terms (level
  zero too), and the product of the indicator matrix with its transpose holds, for every two groups, how many terms have which
  two levels. Products are taken in blocks of terms of similar frequency, which have few levels, for at most ``SOURCES``
  sources a side, as matrices of ones whose sums stay below 2^24 and so are exact; each joint table is priced in integers
  and only one sum a pair leaves a block.
* Part ``term`` ranks the terms that a group prices above its language; only the first ``TOP_TERMS`` are listed.

All arithmetic is exact: prices stay below 2^30 or so, a cost below 2^60, and the sum over a pair's terms below (10^9 + V)^2,
which a long holds for any V below 2 * 10^9; beyond, Spark's overflow check fails the job.

Terms are counted per slice of text, per task and only then shuffled, so a frequent term or source is a row a task. Terms
are dealt by their hash into as many buckets as their counts fill, so that a large language spreads over many tasks.
What must fit into a task is the list of one term's sources and the table of a language's sources.

Null text, lang and source read as ''. A text without terms still makes its group occur. Every row is a document, so repeated
rows count as often as they occur. A language without kept terms has pairs of value 0. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from placewise.llm import common as C
from placewise.session import stage

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
PER_BUCKET = 1 << 15  # counts (term, source) that one task multiplies
SOURCES = 512  # on one side of a product
CELLS = 1 << 21  # of one indicator matrix
COLUMNS = 1 << 10  # of one indicator matrix, unless a single term has more

LETTER = np.frombuffer(C.LOWER, np.uint8).copy()  # A-Z in lower case, other ASCII that is no letter as space
LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def source_divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank (value descending, item ascending, from 1 per part)."""
    empty = F.lit("")
    rows = C.narrow(df, lang=F.coalesce(df[lang_col].cast("string"), empty),
                    source=F.coalesce(df[source_col].cast("string"), empty), text=text_col)
    terms = stage(kept_terms(rows, min_docs), "audit_terms")
    groups = stage(group_totals(rows, terms), "audit_groups")
    pairs = _ranked(pair_values(terms, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    tops = _ranked(term_values(terms, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    return pairs.unionByName(tops.where(F.col("rank") <= top_terms))


def _ranked(df: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, its count ``n`` in the language, and ``counts``, a (source, n) per source that holds it."""
    counts = C.per_chunk(rows, "lang string, source string, term string, n long, docs long", count_terms)
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")
    ).where(F.col("docs") >= min_docs).drop("docs")


def count_terms(batch: pa.RecordBatch) -> dict:
    """Occurrences and documents of each term per (lang, source) of a slice."""
    data, offsets = C.text_buffer(batch.column("text"))
    data = LETTER[data]
    start, end, row = C.split_words(data, offsets)
    at = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[data != 0x20])])
    words = words.dictionary_encode()
    width = max(len(words.dictionary), 1)
    seen, n = np.unique(row * width + words.indices.to_numpy(), return_counts=True)  # per document
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    keys, place = np.unique(group[seen // width] * width + seen % width, return_inverse=True)
    group, term = keys // width, keys % width
    return {"lang": langs.dictionary.take(pa.array(group // max(len(sources.dictionary), 1))),
            "source": sources.dictionary.take(pa.array(group % max(len(sources.dictionary), 1))),
            "term": words.dictionary.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()),
            "n": C.per_row(place, len(keys), n), "docs": C.per_row(place, len(keys))}


def group_totals(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurring group with its ``total``; its language's ``lang_total``, ``size`` (V) and number of ``buckets``."""
    totals = (terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source")
              .agg(F.sum("c.n").alias("total")))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("size"),
                                      (F.floor(F.sum(F.size("counts")) / PER_BUCKET) + 1).alias("buckets"))
    return (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
            .na.fill({"total": 0, "lang_total": 0, "size": 0, "buckets": 1}))


def _price(n: str, total: str) -> F.Column:
    scaled = f"cast({n} + 1 as decimal(20, 0)) * {UNIT}"  # a long would overflow beyond nine billion occurrences
    return F.expr(f"1 + ({scaled} div ({total} + size))")


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a group prices above its language."""
    counts = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("counts").alias("c"))
    priced = counts.select("*", "c.*").join(groups, ["lang", "source"]).select(
        "lang", "source", "item", _price("n", "total").alias("p"), _price("lang_n", "lang_total").alias("q"))
    return priced.where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, from the joint tables of all buckets of terms."""
    buckets = groups.select("lang", "buckets").distinct()
    left = terms.join(buckets, "lang").select("lang", F.expr("pmod(xxhash64(term), buckets)").alias("bucket"), "counts")
    right = groups.select("lang", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "source", "total", "size")
    sums = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(
        _bucket_values, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _bucket_values(terms: pa.Table, groups: pa.Table) -> pa.Table:
    names = groups.column("source").combine_chunks()
    totals = [t + v for t, v in zip(groups.column("total").to_pylist(), groups.column("size").to_pylist())]
    counts = terms.column("counts").combine_chunks()
    each = counts.flatten()
    term = np.repeat(np.arange(len(counts)), counts.value_lengths().to_numpy())
    source = pa.compute.index_in(each.field("source"), value_set=names).to_numpy().astype(np.int64)
    values = joint_values(term, source, each.field("n").to_numpy(), totals)
    one, two = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = pa.repeat(groups.column("lang")[0], len(one)) if len(names) else pa.array([], pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(one)), "item": names.take(pa.array(two)),
                     "value": values[one, two]})


def joint_values(term: np.ndarray, source: np.ndarray, n: np.ndarray, totals: list[int]) -> np.ndarray:
    """The cost of every source (row) against every other (column), over terms 0, 1, ... that hold n > 0 of a source.

    ``totals``: N + V of each source.
    """
    values = np.zeros((len(totals), len(totals)), np.int64)
    if not len(term):
        return values
    frequency = np.bincount(term, weights=n)
    rank = np.empty(len(frequency), np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
    order = np.argsort(rank[term], kind="stable")
    term, source, n = rank[term][order], source[order], n[order]
    sides = range(0, len(totals), SOURCES)
    for begin, end in _blocks(term, source, n, len(frequency), min(len(totals), SOURCES)):
        a, b = np.searchsorted(term, (begin, end))
        tables = [_indicators(term[a:b] - begin, source[a:b], n[a:b], end - begin, totals, s) for s in sides]
        for one, from_one, p in tables:
            for two, from_two, q in tables:
                joint = one.T @ two  # terms with this level of one group and that level of another
                i, j = np.nonzero(joint)
                gap = p[i] - q[j]
                np.add.at(values, (from_one[i], from_two[j]), gap * gap // q[j] * joint[i, j].astype(np.int64))
    return values


def _blocks(term, source, n, n_terms: int, n_sources: int):
    """Ranges of terms whose indicator matrix is small; a single term is always a block."""
    todo = [(0, n_terms)]
    while todo:
        begin, end = todo.pop()
        a, b = np.searchsorted(term, (begin, end))
        columns = len(np.unique(np.stack((source[a:b], n[a:b])), axis=1).T) + n_sources if end - begin > 1 else 0
        if columns > COLUMNS + n_sources or columns * (end - begin) > CELLS:
            todo += [(begin, (begin + end) // 2), ((begin + end) // 2, end)]
        else:
            yield begin, end


def _indicators(term, source, n, n_terms: int, totals: list[int], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``SOURCES`` sources from ``first`` on: a column of ones per (source, level), its source and its price."""
    last = min(first + SOURCES, len(totals))
    mine = (source >= first) & (source < last)
    term, source, n = term[mine], source[mine] - first, n[mine]
    levels, column = np.unique(np.stack((source, n)), axis=1, return_inverse=True)
    zero = levels.shape[1]
    ones = np.zeros((n_terms, zero + last - first), np.float32)
    ones[:, zero:] = 1
    ones[term, zero + source] = 0
    ones[term, column.ravel()] = 1
    owner = np.concatenate((levels[0], np.arange(last - first))) + first
    level = np.concatenate((levels[1], np.zeros(last - first, np.int64)))
    prices = [1 + UNIT * (int(c) + 1) // totals[s] for s, c in zip(owner.tolist(), level.tolist())]
    return ones, owner, np.array(prices, np.int64)
