"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
import registry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
entry.queries()
# The training-data queries have their own tests.
FNS, SQLS = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(FNS) == set(SQLS)
    assert set(FNS) <= set(entry.queries()) and set(SQLS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(FNS))
def test_query(spark, con, name):
    problem = compare(spark, con, FNS[name], SQLS[name], SF)
    assert problem is None or (problem == "no rows on either side" and SF.endswith("sf0.001")), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
