import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placewise.llm import simhash as S
from placewise.llm.components import connected_components


def slow_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, max_bits=2):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    root = {fp: fp for _, fp in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for i, fp in prints:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return Counter((i, f"{fp:016x}", least.get(find(fp))) for i, fp in prints)


def components(df, **kw):
    out = S.simhash_near_dedup(df, **kw)
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect())


def test_golay_code_is_perfect():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 3000)
    index = S.golay_index(words)
    data = np.arange(4096) << 11
    rest = np.zeros(4096, np.int64)
    for p, s in enumerate(S._syndromes()):
        rest ^= ((data >> p) & 1) * s
    codewords = data | rest
    assert np.bitwise_count(codewords[1:]).min() == 7
    assert (np.bitwise_count(codewords[index] ^ words) <= 3).all()


def test_pairs_within_two_bits_share_a_key():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in r.choice(64, int(r.integers(0, 3)), replace=False):
            b[i] ^= np.uint64(1 << int(p))
    keys = []
    for x in (a, b):
        row, key = S.fingerprint_keys(x.view(np.int64))
        keys.append([set(key[row == i].tolist()) for i in range(len(x))])
    assert all(p & q for p, q in zip(*keys))


@pytest.mark.parametrize("small", [2, 64, 10 ** 6])
def test_links_hold_components_together(monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", min(small, 3000))
    r = np.random.default_rng(2)
    centre = 0x0123456789ABCDEF
    fps = np.unique(np.array([centre ^ sum(1 << int(p) for p in r.choice(64, r.integers(0, 5), replace=False))
                              for _ in range(900)], np.uint64))
    row, key = S.fingerprint_keys(fps.view(np.int64))
    order = np.lexsort((fps[row], key))
    a, b = S.run_links(key[order], fps[row][order].view(np.int64), 2)
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) > 0).all()
    ours, all_pairs = S.Forest(len(fps)), S.Forest(len(fps))
    ours.join(np.searchsorted(fps, a.view(np.uint64)), np.searchsorted(fps, b.view(np.uint64)))
    all_pairs.join(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2))
    assert (ours.parent == all_pairs.parent).all()


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert components(documents) == slow_components(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert components(odd) == slow_components(rows)
    assert components(odd, max_bits=0) == slow_components(rows, 0)
    assert components(none) == Counter()
    with pytest.raises(ValueError):
        S.simhash_near_dedup(odd, max_bits=3)


def test_one_row_of_each_component_stays(spark, odd, none):
    want = Counter(c for _, _, c in slow_components([(r.doc_id, r.text) for r in odd.collect()]))
    kept = S.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({c: 1 for c in want})
    assert S.keep_one_of_each(none).count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + hub + [(5000, 5000), (None, 7), (7, None), (3, 4), (4, 3), (1100, 2000), (2000, 2001)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in out.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 1000 for i in range(1001, 1200)}, 2000: 1000, 2001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_matches_the_builtin_hash(spark):
    text = "one two three"
    signed = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert S.fingerprint(text.encode()) == signed % (1 << 64)
