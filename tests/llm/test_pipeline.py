import hashlib
from collections import Counter

import pytest

import corpus_pipeline as P
from placewise.llm import language_id
from placewise.llm.common import crc_rest
from placewise.session import stage
from test_quality import brute as quality_of
from test_simhash import slow_components
from test_suffix import brute as passages_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, apply in P.STAGES:
        after = stage(apply(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_dedup", "packing"]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema.names == before.schema.names and after.dtypes == before.dtypes


def test_languages(stages):
    before, after = stages["language_id"]
    models = language_id.fit_models(before.where(crc_rest("doc_id", 5) != 0))
    rejected = {r.doc_id for r in language_id.predict_languages(before, models, crc_rest("doc_id", 5) == 0).where(
        "rejected").collect()}
    assert ids(after) == sorted(set(ids(before)) - rejected) and len(rejected) < 0.02 * before.count() + 2


def test_quality(stages):
    before, after = stages["quality_rules"]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if quality_of(r.text)[6])


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    found = slow_components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted({c for _, _, c in found})


def test_passages(stages):
    before, after = stages["suffix_dedup"]
    found = passages_of([(r.doc_id, r.text) for r in before.collect()])
    left = {r[0]: (r[1] - r[2], r[4]) for r in found}
    whole = 0
    for r in after.collect():
        assert r.n_chars == len(r.text)
        size, digest = left[r.doc_id]
        if len(r.text.encode()) == size:  # else a character was cut in half
            whole += 1
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
        assert size - 6 * len(found) <= len(r.text.encode()) <= size
    assert whole > 0.9 * after.count() and ids(after) == ids(before)


def test_batches_and_run(spark, stages):
    before, after = stages["packing"]
    assert ids(after) == ids(before)
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "n_tokens", "bucket").collect())) == sorted(
        map(tuple, after.select("doc_id", "n_tokens", "bucket").collect()))


def test_odd_documents(spark, odd, none):
    """Each stage on what the one before left of rows with nulls, repeats, empty and long texts and clashing names."""
    left = odd
    for name, apply in P.STAGES:
        assert apply(spark, none, SF).count() == 0
        before, left = left, stage(apply(spark, left, SF), name)
        if name != "packing":
            assert left.columns == odd.columns
    assert Counter(ids(left)) == Counter(ids(before))
