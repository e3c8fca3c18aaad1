import random
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import language_id as L
from placewise.llm.common import crc_rest

NO_CONTEXT = (L.START,) * (L.ORDER - 1)


def kneser_ney(texts):
    """Interpolated Kneser-Ney by the textbook, on dictionaries."""
    tops = Counter()
    for t in texts:
        codes, _ = L.symbols([t])
        codes = tuple(int(c) for c in codes)
        tops.update(codes[i - L.ORDER + 1:i + 1] for i in range(L.ORDER - 1, len(codes)))
    counts = {L.ORDER: tops}
    for k in range(L.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def probability(counts, gram, floor):
    if not gram:
        return floor
    table = counts[len(gram)]
    once, twice = (sum(v == n for v in table.values()) for n in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    follow = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
    lower = probability(counts, gram[1:], floor)
    if not follow:
        return lower
    total = sum(follow.values())
    return max(table[gram] - d, 0) / total + d * len(follow) / total * lower


def test_models_are_interpolated_kneser_ney():
    texts = {"aa": ["abc abd abc.", "bad cab"], "bb": ["xyz xyz ab", "zyx!"]}
    rows = defaultdict(Counter)
    for i, lang in enumerate(texts):
        for g, n in kneser_ney(texts[lang])[L.ORDER].items():
            rows[i][g] = n
    flat = [(i, g, n) for i, c in rows.items() for g, n in c.items()]
    models = L.Models(np.array([g for _, g, _ in flat], np.uint64), np.array([i for i, _, _ in flat]),
                      np.array([n for _, _, n in flat], float), list(texts))
    kinds = {g[-1] for c in rows.values() for g in c}
    floor = 1 / (len(kinds) + 1)
    for probe in ("abc zq", "Xyz xyz", "  cab!!bad"):
        codes, text = L.symbols([probe])
        loss, length = models.losses(codes, text, 1)
        for i, lang in enumerate(texts):
            counts = kneser_ney(texts[lang])
            want = -sum(log(probability(counts, tuple(int(c) for c in codes[j - L.ORDER + 1:j + 1]), floor))
                        for j in range(L.ORDER - 1, len(codes)))
            assert loss[0, i] * length[0] == pytest.approx(want, rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    counts = kneser_ney(["abc abd abc.", "bad cab"])
    kinds = {g[-1] for g in counts[L.ORDER]}
    floor = 1 / (len(kinds) + 1)
    for context in (NO_CONTEXT, (97, 98), (120,)):
        whole = sum(probability(counts, (*context[-L.ORDER + 1:], k), floor) for k in [*kinds, 999_999])
        assert whole == pytest.approx(1)


def test_held_out_accuracy(spark, documents):
    rest = crc_rest("doc_id", 5)
    models = L.fit_models(documents.where(rest != 0))
    out = L.predict_languages(documents, models, rest == 0).join(documents.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(
        F.col("rejected").cast("int"))).first()
    assert held[0] >= 0.98 and held[1] <= 0.02
    assert out.where("score < 0 or score > 1").count() == 0


def test_gibberish_is_rejected(spark, documents):
    models = L.fit_models(documents)
    noise = "".join(random.Random(1).choices("qxzjkvwy", k=3000))
    assert models.predict([noise])["rejected"][0]


def test_odd_rows(spark, odd, none, documents):
    models = L.fit_models(documents)
    out = {(r.doc_id, r.lang_pred, r.rejected) for r in L.predict_languages(odd, models, F.lit(False)).collect()}
    assert {(2, "und", True), (None, "und", True), (3, "und", True), (4, "und", True), (12, "und", True)} <= out
    assert L.predict_languages(none, models, F.lit(False)).count() == 0
    untrained = L.fit_models(none)
    assert {r.lang_pred for r in L.predict_languages(odd, untrained, F.lit(True)).collect()} == {"und"}
    kept = L.keep_identified(odd, models)
    assert kept.columns == odd.columns
