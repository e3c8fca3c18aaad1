import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from placewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    return local_session(4, memory="8g", app="tests", options={
        "spark.sql.warehouse.dir": str(shared / "warehouse"), "spark.checkpoint.dir": str(shared / "checkpoints")})


@pytest.fixture
def table(spark):
    """table("a int, b string", (1, "x"), ...)"""
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)
    return make


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    out = [tuple(r) for r in df.select(*(order or df.columns)).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture
def as_rows():
    return rows
