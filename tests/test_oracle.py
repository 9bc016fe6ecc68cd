"""Every registered query against its SQL, on the smallest tables."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import rows_of, tables

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
OWN = [n for n in sorted(entry.queries()) if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def duck():
    return tables(SF_DIR)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = rows_of(df.columns, df.collect())
    assert got[1]
    if name in ORACLE:
        duck.execute(ORACLE[name])
        want = rows_of([d[0] for d in duck.description], duck.fetchall())
        assert got == want


def test_every_query_has_sql():
    assert not set(OWN) - set(ORACLE)
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
