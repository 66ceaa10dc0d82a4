"""Every registered query against its SQL twin, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as entry
from checks.catalog import ORACLES, QUERIES
from compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Row-at-a-time Python, all-pairs joins and whole-group Python have no place in any plan.
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    result = compare(con, df, ORACLES[name])
    assert result in ("", "EMPTY"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_registers_them_all():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.items() <= entry.oracle_sql().items()


def list_lines(spark, tmp_path, keys, form):
    from checks.location_queries import _large_list
    from checks.registry import Tables

    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    return _large_list(Tables(spark, str(tmp_path)), form)


def test_list_texts_are_made_after_the_sort(spark, tmp_path):
    """The one task that writes a list sorts keys alone, many in a row (F5)."""
    keys = [7, 3, 3, None, 250_000, 40_000, 12]
    lines = list_lines(spark, tmp_path, keys, "array")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("goo.gl") < plan.index("Sort [place") and "goo.gl" not in plan[plan.index("Sort [place"):]
    got = [r.value for r in lines.collect()]
    item = 'https://maps.app.goo.gl/s{}?q=' + "x" * 1200
    want = [f'  "{item.format(k)}",' for k in (3, 3, 7, 12, 40_000)] + [f'  "{item.format(250_000)}"']
    assert (got[0], got[-1], [v for v in got[1:-1] if v is not None], got.count(None)) == ("[", "]", want, 1)


def test_places_of_every_order_are_collected(spark):
    """Pages announce two orders; each place of either is in the result (F3)."""
    found = {r.place_key for r in QUERIES["collect_places"](spark, SF_DIR).select("place_key").collect()}
    uncapped = {r.place_key for r in QUERIES["collect_places_uncapped"](spark, SF_DIR).select("place_key").collect()}
    assert found == uncapped and {int(k) % 2 for k in found} == {0, 1}
