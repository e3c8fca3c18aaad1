import hashlib
import re

import pytest

from placewise.llm import fill_in_middle as M


def brute(doc_id, text):
    """The contract, on code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def check(df):
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = [(i, *brute(i, t)) for i, t in texts]
    got = [tuple(r) for r in M.fill_in_middle(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    digests = [tuple(r) for r in M.fim_digests(df).collect()]
    assert sorted(digests, key=str) == sorted(((*w[:-1], sha(w[-1]), sha(t)) for w, (_, t) in zip(want, texts)), key=str)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, none):
    check(odd)
    assert M.fim_digests(none).count() == 0 and M.fill_in_middle(none).count() == 0


def test_sentinels_and_lines(table):
    texts = ["\n", "\n\n\n", "a\nb", "a\nb\n", "x <P> y\nz", "<S>", "a<M>\n", "<\n<\nP>\n", "S>\n<P\n>", "é\n漢\n\U0001f600", "<P\n><S\n"]
    check(table("doc_id long, text string", *[(i, t) for i in range(12) for t in texts]))


def test_both_forms_occur_and_texts_come_back(spark, documents):
    out = M.fill_in_middle(documents)
    assert {r.form for r in out.select("form").distinct().collect()} >= {"spm", "psm"}
    back = M.restore_texts(out).selectExpr("doc_id", "text")
    want = documents.selectExpr("doc_id", "coalesce(text, '') text")
    assert back.exceptAll(want).count() == 0 and back.count() == want.count()


def test_shares(table):
    df = table("doc_id long, text string", *[(i, "a\nb\nc") for i in range(400)])
    count = lambda out: {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert count(M.fill_in_middle(df, fim_percent=0)) == {"plain": 400}
    assert count(M.fill_in_middle(df, spm_percent=100)) == {"spm": 400}
    half = count(M.fill_in_middle(df, fim_percent=50))
    assert 150 < half["plain"] < 250 and 50 < half["psm"] < 150


@pytest.mark.parametrize("cut", range(6))
def test_rotation(cut):
    buffer = bytearray(b"..abcde..")
    M.rotate(buffer, 2, 2 + cut, 7)
    word = b"abcde"
    assert buffer == b".." + word[cut:] + word[:cut] + b".."
