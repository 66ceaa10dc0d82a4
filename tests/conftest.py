import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from placelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "tests")
    yield session
    session.stop()


@pytest.fixture
def check(spark):
    """Runs a table of (input.., expected) through one column expression."""

    def run(cases, expression, schema):
        rows = [(i, *c) for i, c in enumerate(cases)]
        df = spark.createDataFrame(rows, f"i int, {schema}, expected string")
        got = df.select("i", expression(df).cast("string").alias("got"), "expected").collect()
        wrong = [(cases[r.i], r.got) for r in got if r.got != r.expected]
        assert not wrong

    return run
