import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD_DOCS = [  # nulls, empty and long texts, repeated rows, odd white space, one word, many equal lines
    (1, "the cat sat on the mat and the dog sat on the log near the old mill by the river bank"),
    (1, "the cat sat on the mat and the dog sat on the log near the old mill by the river bank"),
    (2, None), (None, "a null id with some words in it"), (None, None), (3, ""), (4, " \t\n\x0b "), (5, "word"),
    (6, "two words"), (7, "the CAT sat on the mat and the dog sat on the log near the old mill by the river bank"),
    (8, "line one\n" * 400), (9, "x" * 5000), (10, "éàü ßÀ 漢字   \x1c mixed ſ"), (11, "long text " * 20000),
    (12, "1234 5678 !!! ???"),
]


@pytest.fixture
def odd(spark):
    """Documents of all odd kinds, with extra columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars",
                         "1 as fp", "2 as block", "3 as rows", "'k' as key", "4 as id", "5 as number", "6 as part",
                         "true as held_out", "7 as bucket", "8 as n_tokens")


@pytest.fixture
def none(odd):
    return odd.limit(0)


def plain(df, *cols):
    """Rows as tuples in a stable order."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()),
                  key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture
def as_plain():
    return plain
