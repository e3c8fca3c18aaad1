"""A training corpus from raw documents: language, quality, near-duplicates, repeated passages, batches.

Each stage works on all rows its predecessor kept. All but the last return the columns of ``documents``; rows without a
language or of poor quality go, one row of each near-duplicate group stays, repeated passages are cut out of the texts
(``n_chars`` follows), and the last stage deals the documents into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewise.llm import common, language_id, packing, quality, simhash, suffix_dedup
from placewise.session import stage


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; they learn from the labelled documents that are not held out."""
    models = language_id.fit_models(docs.where(common.crc_rest("doc_id", 5) != 0))
    return language_id.keep_identified(docs, models)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return common.keep_rows(docs, "text", lambda texts: quality.measures(texts)["kept"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at two bits or fewer."""
    return simhash.keep_one_of_each(docs, shingle=3, max_bits=2)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier document holds."""
    return suffix_dedup.remove_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_into_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document."""
    return packing.pack_batches(docs)


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_into_batches),
]
ORACLE_SQL = None  # the language models and fingerprints are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
