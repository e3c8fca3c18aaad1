import hashlib
import re

import pytest

from placewise.llm import decontaminate as D

ITEMS = [
    (1, "The CAT sat on the mat and the dog sat on the log near the old mill."), (2, "two words"), (3, None), (4, " ?! "),
    (5, "long text long text long text long text long text"), (6, "dog sat on the log near the old mill"), (7, "漢字"),
    (8, "éàü"), (2, "line one line one line"), (None, "word"), (10, "with some words in it"), (11, "nowhere to be found at all"),
]


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    words, hit, names = split(text), set(), set()
    for item, item_text in items:
        own = split(item_text)
        n = min(len(own), 10)
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        places = [i for i in range(len(words) - n + 1) if grams and tuple(words[i:i + n]) in grams]
        hit.update(i + j for i in places for j in range(n))
        if places and item is not None:
            names.add(str(item))
    return words, hit, sorted(names)


def check(df, benchmark, items, **options):
    want = []
    for r in df.select("doc_id", "text").collect():
        words, hit, names = brute(r.text, items)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        want.append((r.doc_id, len(words), len(hit), len(names), sha, bool(hit)))
    got = [tuple(r) for r in D.contamination(df, benchmark, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


@pytest.fixture
def items(table):
    return table("item_id long, text string, words string, key string", *[(*i, "w", "k") for i in ITEMS])


@pytest.mark.parametrize("limit", [1 << 20, 0])  # broadcast, shuffled
def test_odd_rows(odd, none, items, limit):
    want = check(odd, items, ITEMS, broadcast_bytes=limit)
    assert sum(w[-1] for w in want) >= 7
    assert D.contamination(none, items, broadcast_bytes=limit).count() == 0
    check(odd, items.limit(0), [], broadcast_bytes=limit)


def test_both_joins_on_documents(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    assert sum(w[-1] for w in check(documents, bench, items)) > 0
    check(documents, bench, items, broadcast_bytes=0)


def test_equal_hashes_are_told_apart(odd, items, monkeypatch):
    monkeypatch.setattr(D, "window_key", lambda n, words: D.F.length(words[0]).cast("long"))
    check(odd, items, ITEMS)


def removed(text, items):
    """Cut from the first to the last character of each run of hit words."""
    _, hit, _ = brute(text, items)
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at:places[i][0]]
        at = places[i][1]
    return None if text is None else out + text[at:]


def test_spans_are_cut_and_documents_dropped(odd, items):
    df = odd
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = D.remove_spans(df, items)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(((i, removed(t, ITEMS)) for i, t in texts), key=str)
    kept = D.drop_contaminated(df, items)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(((i, t) for i, t in texts if not brute(t, ITEMS)[1]), key=str)


def test_cut_texts(table, items):
    texts = ["... two-words, and more", "and two\twords", "two words two words x two words!", "a two words. b", "two words",
             "é; the cat sat on the mat and the dog sat on the log near it", "Two\x7fWORDS\n\nTwo words x", ""]
    out = D.remove_spans(table("doc_id long, text string", *enumerate(texts)), items).orderBy("doc_id").collect()
    assert [r.text for r in out] == [removed(t, ITEMS) for t in texts]


def test_no_python_in_the_plan(documents, spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = D.contamination(documents, bench)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|MapPartitions|ExistingRDD", plan)
    assert plan.split("== Physical Plan ==")[1].count("split(") == 1  # the texts are split once
