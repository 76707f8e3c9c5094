"""Every registered query on the smallest tables, beside its SQL twin where it has one."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check import compare, connect  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Nothing crosses two tables, and no Python runs row by row.
    assert not [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if n in plan]
    got = df.toPandas()
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) is None
    else:
        assert len(got)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
