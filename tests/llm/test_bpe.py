import array
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placewise.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    theirs = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        return theirs, B.Bpe(f.read())


def same(pair, texts):
    theirs, ours = pair
    for text, enc, (ids, decoded) in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), ours.encode(texts)):
        assert list(array.array("I", ids)) == enc.ids, text
        assert decoded.decode() == theirs.decode(enc.ids, skip_special_tokens=False), text


def test_hard_texts(pair):
    same(pair, ["", "  ", "Hello  World's <|endoftext|>x<|startoftext|> don't''s \x1c a\x1cb \x85 z", "ΑΣ ΣΑΣ İstanbul é ﬁ Ǆ",
                "aaa aaaaaaa aaaa" * 3, "😀😀 日本語 <|endoftext|", "_" * 50 + "-" * 77, "x" * 3000, "12 ²½ ٣ 'S 'LL", "the " * 50])


def test_random_texts(pair):
    r = random.Random(3)
    pool = "aAbBéÉ'’sStTrRvVeEmMlLdD 01٣\t\n 　<|>endoftext.-_ΣσςİıßẞǅŁł̧́😀漢カ\x00\x1f\x7f\x85"
    same(pair, ["".join(r.choices(pool, k=r.randint(1, 40))) for _ in range(3000)])


def test_documents_and_a_full_word_table(pair, documents, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 500)
    texts = [r.text for r in documents.select("text").collect()]
    for at in range(0, len(texts), 50):
        same(pair, texts[at:at + 50])


def test_digests_and_round_trip(spark, odd, none, pair):
    theirs, ours = pair
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.bpe_digests(odd, PATH).collect()}
    want = set()
    for i, text in [(r.doc_id, r.text or "") for r in odd.collect()]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(),
                  hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert B.bpe_digests(none, PATH).count() == 0
    for r in B.bpe_codes(odd, PATH).collect():
        assert ours.decode(list(array.array("I", r.ids))).encode() == bytes(r.decoded)


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, TypeError, KeyError)):
        B.Bpe(f.read())
