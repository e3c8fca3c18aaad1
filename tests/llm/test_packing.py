from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import packing as P


def least_padding(lengths, buckets):
    kinds = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(kinds))):
        for cuts in combinations(kinds[:-1], k):
            ends = [*cuts, kinds[-1]]
            pad = sum(min(e for e in ends if e >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 60, 80) ** 2
    kinds, count = np.unique(lengths[:int(r.integers(1, 30))], return_counts=True)
    used = np.repeat(kinds, count).tolist()
    for buckets in (1, 2, 3, 4):
        ends, padding = P.best_boundaries(kinds, count, kinds * count, buckets)
        assert padding == least_padding(used, buckets) == sum(min(e for e in ends if e >= n) - n for n in used)
        assert len(ends) <= buckets and ends == sorted(ends)


def test_classes_ascend(spark):
    rows = spark.range(0, 200_000, 7).select("id", P.length_class(F.col("id")).alias("c")).orderBy("id").collect()
    assert all(a.c <= b.c for a, b in zip(rows, rows[1:])) and len({r.c for r in rows}) < 3000
    spans = {}
    for r in rows:
        spans.setdefault(r.c, []).append(r.id)
    assert all(max(s) - min(s) <= max(s) / 128 for s in spans.values())


def check(df, budget=P.BUDGET, **kw):
    rows = P.pack_batches(df, budget=budget, **kw).collect()
    assert Counter(r.doc_id for r in rows) == Counter(
        r.doc_id for r in df.select("doc_id").collect())
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.bucket_len, r.batch), []).append(r.n_tokens)
    per_bucket = {}
    for (bucket, size, _), held in batches.items():
        assert len(held) * size <= budget or len(held) == 1
        per_bucket.setdefault(bucket, []).append((len(held), size))
    for found in per_bucket.values():  # all batches of a bucket but one are full
        assert sum(n < max(1, budget // max(size, 1)) for n, size in found) <= 1
    return rows


def test_documents(documents):
    rows = check(documents)
    tokens = documents.select(F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")).alias("n")).agg(F.sum("n"))
    assert sum(r.n_tokens for r in rows) == tokens.first()[0]


def test_small_slices_and_budget(documents, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 7)
    check(documents, budget=900, buckets=3)


def test_odd_rows(odd, none):
    rows = check(odd, budget=100)
    assert {r.n_tokens for r in rows if r.doc_id == 2} == {0}
    out = P.pack_batches(none)
    assert out.count() == 0 and out.columns == P.pack_batches(odd).columns


def plain_boundaries(kinds, count, buckets):
    """Least padding by the plain dynamic programme over all places of the last boundary."""
    docs, held = np.cumsum([0, *count]), np.cumsum([0, *(kinds * count)])
    cost = np.array([0] + [1 << 60] * len(kinds))
    for _ in range(buckets):
        cost = np.array([0] + [min(cost[i] + kinds[j - 1] * (docs[j] - docs[i]) - (held[j] - held[i]) for i in range(j))
                               for j in range(1, len(kinds) + 1)])
    return cost[-1]


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_of_many_lengths(seed):
    r = np.random.default_rng(seed)
    kinds = np.unique(r.integers(0, 5000, 150 + seed))
    count = r.integers(1, 50, len(kinds)) ** 2
    for buckets in (1, 2, 7, 16):
        ends, padding = P.best_boundaries(kinds, count, kinds * count, buckets)
        used = np.array(ends)[np.searchsorted(ends, kinds)]
        assert padding == plain_boundaries(kinds, count, buckets) == ((used - kinds) * count).sum()


def test_long_documents_are_cut_at_the_best_length(spark):
    """2,000 and 2,001 words are in one class of 1/128; a bucket may end between them."""
    rows = [(i, "w " * n) for i, n in enumerate([2000] * 50 + [2001] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.padding for r in check(df, buckets=2)) == 0


def test_more_lengths_than_go_to_the_driver(documents, monkeypatch):
    monkeypatch.setattr(P, "MOST_LENGTHS", 10)
    check(documents)
