import math
import re
import zlib
from collections import Counter

import pytest

from placewise.llm import lm_score as L
from placewise.llm.common import crc_rest


def brute(rows, state_share=L.STATE_SHARE, arc_share=L.ARC_SHARE):
    def tokens(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    def held(i):
        return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2

    train = [tokens(t) for i, t in rows if not held(i)]
    end = object()  # also the start, as a history
    counts = Counter(w for d in train for w in d)
    if train:
        counts[end] = len(train)
    n, v = sum(counts.values()), len(counts)
    states = {w for w, k in counts.items() if w is not end and k >= max(2, state_share * n)} | {end}
    pairs = Counter((a, b) for d in train for a, b in zip([end] + d, d + [end]) if a in states and b in states)
    pairs = {p: k for p, k in pairs.items() if k >= max(2, arc_share * n)}

    def root(w):
        return (counts[w] + 1) / (n + v + 1)

    taken, freed = Counter(), Counter()
    for (a, b), k in pairs.items():
        taken[a] += (k - L.DISCOUNT) / counts[a]
        freed[a] += root(b)
    out = []
    for i, t in rows:
        read = tokens(t) + [end]
        base, score, state = 0.0, 0.0, end
        for w in read:
            base += math.log10(root(w))
            if (state, w) in pairs:
                score += math.log10((pairs[state, w] - L.DISCOUNT) / counts[state])
            else:
                score += math.log10(root(w) * ((1 - taken[state]) / (1 - freed[state]) if state else 1))
            state = w if w in states else None
        out.append((i, held(i), len(read), sum(counts[w] > 0 for w in read), n, base, score))
    return out


def same(df, rows, **kw):
    def key(r):
        return str(r[0]), r[2], round(r[5], 6)

    got = sorted((tuple(r) for r in L.lm_scores(df, crc_rest("doc_id", 7) == 2, **kw).collect()), key=key)
    want = sorted(brute(rows, **{k: v for k, v in kw.items() if k != "block_bytes"}), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("block", [L.BLOCK_BYTES, 20_000])
def test_documents(documents, block):
    same(documents, [(r.doc_id, r.text) for r in documents.collect()], block_bytes=block)


def test_shares(documents):
    same(documents, [(r.doc_id, r.text) for r in documents.collect()], state_share=1e-3, arc_share=1e-4)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(odd.drop("held_out"), rows)
    same(odd, rows, block_bytes=1)
    assert L.lm_scores(none, crc_rest("doc_id", 7) == 2).count() == 0
    untrained = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    same(spark.createDataFrame(untrained, "doc_id long, text string"), untrained)


def test_probabilities_of_a_state_sum_to_one():
    rows = [(i, "a b a c b a b") for i in range(5)]
    vocabulary = {"a": 15, "b": 15, "c": 5}
    import numpy as np

    words = [w.encode() for w in sorted(vocabulary)]
    pairs = Counter((x, y) for _, t in rows for x, y in zip(["^", *t.split()], [*t.split(), "$"]))
    number = {"a": 0, "b": 1, "c": 2, "^": 3, "$": 3}
    keys = np.array(sorted(number[x] * 4 + number[y] for x, y in pairs))
    seen = np.array([next(k for (x, y), k in pairs.items() if number[x] * 4 + number[y] == key) for key in keys])
    machine = L.Automaton(words, np.array([vocabulary[w] for w in sorted(vocabulary)]), keys, seen, 5, 40, 4)
    root = np.log10((np.array([15, 15, 5, 5, 0]) + 1) / machine.whole)
    for state in (-1, 0, 1, 2, 3):
        p = machine.traverse(np.full(5, state), np.array([0, 1, 2, 3, -1]), root)
        assert (10 ** p).sum() == pytest.approx(1)


def test_rare_pairs_of_a_large_corpus_are_arcs(spark):
    """A pair seen twice among 2.4 million words, of words seen twice, is an arc between states."""
    rows = [(i, "common words all over " * 3000) for i in range(200)] + [(1000, "rare pair"), (1001, "rare pair")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.lm_scores(df, crc_rest("doc_id", 7) == 7)
    got = out.where("doc_id = 1000").first()
    total = 200 * 12000 + 4 + 202
    assert got.train_tokens == total
    first, arc, end = math.log10((2 - L.DISCOUNT) / 202), math.log10((2 - L.DISCOUNT) / 2), math.log10((2 - L.DISCOUNT) / 2)
    assert got.score == pytest.approx(first + arc + end)


def test_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_BYTES", 20_000)
    same(documents, [(r.doc_id, r.text) for r in documents.collect()], block_bytes=20_000)
