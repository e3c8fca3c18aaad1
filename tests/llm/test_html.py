import html
import re

import numpy as np
import pytest

from placewise.llm import html_extract as H
from placewise.llm.html_blocks import leaf_blocks
from placewise.llm.page_layouts import labelled_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return H.fit_field(pages)


def article_of(page):
    """The article of the test pages, by plain text cutting (their markup is regular)."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_test_pages_are_extracted_whole(spark, pages, field):
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract_pages(pages, field).collect()}
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_unseen_layouts(field):
    wrong = total = 0
    for page in labelled_pages(300, seed=99):
        blocks = leaf_blocks(page)
        labels = H.layout_labels(blocks)
        wrong += (field.decode(field.scores(H.features(blocks))) != labels).sum()
        total += len(labels)
    assert wrong < 0.005 * total


@pytest.mark.parametrize("part", [
    "<aside><h3>More stories</h3><p>Some longer prose here, which is an aside.</p></aside>",
    "<div class='cookie-notice'>We use cookies. Some are needed, others are not.</div>",
    "<section class='comments'><p>I liked this article very much. Thank you.</p></section>",
    "<form><label>Your name</label><textarea>write here</textarea></form>", "<div class='ad'>Buy this thing now.</div>",
    "<script>var a = '<p>no</p>';</script>", "<style>p { color: red }</style>", "<!-- <p>old text</p> -->",
    "<footer>&copy; 2020 the owner</footer>", "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul></nav>"])
def test_parts_that_go(field, part):
    prose = "<h1>A title</h1><p>First paragraph of it.</p><p>Second &amp; last one, with some more words.</p>"
    page = f"<html><body>{part}<article>{prose}</article>{part}</body></html>"
    assert H.main_text(page, field) == "A title\nFirst paragraph of it.\nSecond & last one, with some more words."


def test_blocks():
    page = ("<p>a&nbsp;<b>b\n c</b><br>d<p>e</p><ul><li>f<li>g</ul><div title='x > y'>h<span>i</span></div>"
            "<script>if (a < b) '</p>'</script><textarea>j <p>k</textarea><p>l &am")
    assert [b.text for b in leaf_blocks(page)] == ["a b c d", "e", "f", "g", "hi", "j <p>k", "l &am"]
    for broken in ("", "<", "<p", "<p class='", "</", "text <b", "<!--", "<script>", "&#", "a < b > c", "<p>x</p" * 3):
        leaf_blocks(broken)
    assert [b.text for b in leaf_blocks("<p>x<foo")] == ["x"]
    assert [b.text for b in leaf_blocks("<p>a < b &lt;c")] == ["a < b <c"]


def test_marginals_and_decoding_against_enumeration():
    r = np.random.default_rng(0)
    f = H.Field(["a"])
    f.moves = r.normal(size=(2, 2))
    lengths = [1, 3, 5]
    unary = np.zeros((3, 5, 2))
    inside = np.arange(5)[None, :] < np.array(lengths)[:, None]
    unary[inside] = r.normal(size=(9, 2))
    single, double = f._marginals(unary, inside)
    pairs = np.zeros((2, 2))
    for s, n in enumerate(lengths):
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(1 << n)]
        value = [sum(unary[s, t, y[t]] for t in range(n)) + sum(f.moves[y[t], y[t + 1]] for t in range(n - 1)) for y in paths]
        p = np.exp(value) / np.exp(value).sum()
        for t in range(n):
            assert single[s, t, 1] == pytest.approx(sum(q for q, y in zip(p, paths) if y[t]))
        for q, y in zip(p, paths):
            for t in range(n - 1):
                pairs[y[t], y[t + 1]] += q
        assert f.decode(unary[s, :n]).tolist() == [bool(v) for v in paths[int(np.argmax(value))]]
    assert double == pytest.approx(pairs)


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<p>"), (3, "w", "no markup at all"),
            (4, "x", "<article>" + "<p>many words here.</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {(r.page_id, r.url): r.n_chars for r in H.extract_pages(df, field).collect()}
    assert got[1, "u"] == got[None, None] == got[2, "v"] == 0 and got[4, "x"] == 20000 * 17 - 1
    assert H.extract_pages(df.limit(0), field).count() == 0
    assert H.fit_field(df.limit(0), layouts=20).decode(np.zeros((2, 2))).shape == (2,)


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){f()}</script>", "<script>if(a<b)c='it</script>", '<script>d="<b title=\\"x";</script>',
    "<script>var a = '<!--';</script>", "<script>'<!--'</script><!-- x -->", "<style>p:before{content:'<a'}</style>",
    "<title>a <b and \"c</title>", "<SCRIPT>i<n</SCRIPT >"])
def test_raw_text_ends_at_its_own_tag(raw):
    page = f"<html><body>{raw}<article><p>One.</p>{raw}<p>Two.</p></article></body></html>"
    assert [b.text for b in leaf_blocks(page)] == ["One.", "Two."]
    assert [b.path[-2].tag for b in leaf_blocks(page)] == ["article", "article"]
