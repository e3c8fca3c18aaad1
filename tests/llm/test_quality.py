import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from placewise.llm import common as C, quality as Q


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def covered(words, n):
    seen = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return {i + j for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for j in range(n)}


def brute(text):
    words = words_of(text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            dup_chars += sum(map(len, words_of(line))) if line in seen else 0
            seen.add(line)
    repeat = len(covered(words, 8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    shares = {n: sum(len(words[i]) for i in covered(words, n)) / max(chars, 1) for n in Q.MAX_NGRAM_SHARE}
    good = dup_chars / max(chars, 1) <= Q.MAX_DUP_LINE_CHARS and all(shares[n] <= m for n, m in Q.MAX_NGRAM_SHARE.items())
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, failed, not failed and good,
            pytest.approx(max(shares.values())))


def check(df):
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in Q.quality_rules(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "worst_ngram_share").collect()), key=str)
    assert sorted(r[0] or -1 for r in got) == sorted(i or -1 for i, _ in texts)
    for i, text in texts:
        assert any(r[0] == i and r[1:] == brute(text) for r in got), (i, text and text[:50])


def test_documents(documents):
    check(documents)


def test_odd_rows(spark, odd, none):
    check(odd)
    assert Q.quality_rules(none).count() == 0


def test_texts_do_not_mix():
    texts = ["a b c d e f g h i", "a b c d e f g h i", "x", "", None, "p q\np q\n\n \np q", "p q"]
    out = Q.measures(pa.array(texts, pa.string()))
    assert out["n_repeat_words"].tolist() == [0] * 7
    assert out["n_dup_lines"].tolist() == [0, 0, 0, 0, 0, 2, 0]


def test_overlapping_windows():
    text = " ".join("abcdefgh") + " " + " ".join("abcdefgh" * 2) + " " + " ".join(f"w{i}" for i in range(30))
    assert Q.measures(pa.array([text]))["n_repeat_words"][0] == brute(text)[4] == 24


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_equal_hashes_are_no_proof():
    """Two lines, or words, whose polynomials modulo 2**64 agree for every odd factor."""
    x, y = thue_morse(4096), thue_morse(4096, "b", "a")
    words = " ".join(f"w{i}" for i in range(30))
    texts = [f"{x}\n{y}", f"{x}\n{y}\n{y}\n{x}", " ".join([f"{x} a b c d e f g", f"{y} a b c d e f g", words])]
    out = Q.measures(pa.array(texts))
    assert out["n_dup_lines"].tolist() == [0, 2, 0]
    assert out["n_repeat_words"].tolist() == [brute(t)[4] for t in texts] == [0, 0, 0]


@pytest.mark.parametrize("at_once", [1, 3, 1 << 20])
def test_ranges_behind_equal_keys(at_once):
    words = [b"aa", b"ab", b"aa", b"", b"abc", b"ab", b"", b"ba", b"aa"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for keys in (np.zeros(9, np.uint64), np.array([len(w) for w in words]), np.array([hash(w) for w in words])):
        got = C.same_ranges(data, start, end, keys, at_once)
        assert [[a == b for b in got] for a in got] == [[a == b for b in words] for a in words]
    assert not len(C.same_ranges(data, start[:0], end[:0], start[:0]))
