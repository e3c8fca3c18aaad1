import re
from collections import Counter

import numpy as np
import pytest

from placewise.llm import divergence as D


def brute(docs, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= min_docs]
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in sources}
        whole = sum(counts.values(), Counter())

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: prices(counts[s]) for s in sources}, prices(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (r[0], r[1].encode()))
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(rows[:most], 1)]
    return out


def check(df, **options):
    docs = [tuple(r) for r in df.select("lang", "source", "text").collect()]
    got = [tuple(r) for r in D.source_divergence(df, **options).collect()]
    assert sorted(got) == sorted(brute(docs, *options.values()))
    return got


def test_documents(documents):
    parts = Counter(r[2] for r in check(documents))
    assert parts["pair"] and parts["term"]


def test_odd_rows(table, odd, none):
    check(odd)  # one source: no pairs
    assert D.source_divergence(none).count() == 0
    rows = [("en", "a", "The the THE cat"), ("en", "a", "the cat"), ("en", "b", "the É dog"), ("en", "b", "the é dog"),
            ("en", None, "dog the"), ("en", "c", None), ("en", "c", ""), (None, "a", "x"), (None, "b", "y"), (None, None, None),
            ("fr", "a", "z " * 5000 + "été"), ("fr", "b", "z été"), ("fr", "b", "z été"), ("fr", "b", "z 12 _ été"), ("de", "a", "1")]
    got = check(table("lang string, source string, text string, term int, n int, counts int, bucket int, value int, size int",
                      *[(*r, *[7] * 6) for r in rows]))
    assert ("", "a", "pair", "b", 0, 2) in got  # no kept terms
    check(table("lang string, source string, text string", *rows), min_docs=1, top_terms=2)


def test_small_blocks_and_buckets(documents, monkeypatch):
    whole = sorted(map(tuple, D.source_divergence(documents).collect()))
    for name, value in (("PER_BUCKET", 300), ("SOURCES", 3), ("CELLS", 400), ("COLUMNS", 20)):
        monkeypatch.setattr(D, name, value)
    assert sorted(map(tuple, D.source_divergence(documents).collect())) == whole


@pytest.mark.parametrize("seed", range(4))
def test_joint_tables(seed, monkeypatch):
    """Against the sum over terms; counts so large that their price needs more than a long."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(D, "CELLS", 1 << 10)
    counts = rng.geometric(0.2, (150, 9)) * rng.integers(0, 2, (150, 9))
    counts[:2] *= 10**10
    totals = [int(t) + 150 for t in counts.sum(0)]
    term, source = np.nonzero(counts)
    got = D.joint_values(term, source, counts[term, source], totals)
    p = [[1 + 10**9 * (int(c) + 1) // t for c, t in zip(row, totals)] for row in counts]
    assert got.tolist() == [[sum((r[i] - r[j]) ** 2 // r[j] for r in p) for j in range(9)] for i in range(9)]
