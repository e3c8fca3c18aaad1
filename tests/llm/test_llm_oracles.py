"""The registered SQL against its query; the registered names; nothing else imports the folder."""

import pathlib

import pytest

from placewise.llm import queries as Q
from verification.compare import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parents[2]


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_same_rows(spark, name):
    assert compare(Q.QUERIES[name](spark, SF), connect(SF), Q.ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_only_the_entry_and_the_pipeline_import_the_folder():
    users = {p.name for p in [*ROOT.glob("*.py"), *(ROOT / "placewise").rglob("*.py"), *(ROOT / "verification").rglob("*.py")]
             if "llm" not in p.parts and "placewise.llm" in p.read_text()}
    assert users == {"__spark_entry__.py", "corpus_pipeline.py"}
