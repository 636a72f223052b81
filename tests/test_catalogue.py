"""Every query of the catalogue against its SQL twin, on the smallest tables."""

import sys

import pytest

import oracle
from factspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    note, ok = oracle.compare(spark, con, SF, name, catalogue.QUERIES[name], catalogue.SQL.get(name))
    assert ok, note


def test_scans_are_narrow(spark):
    """Filters and columns reach the reader."""
    plan = catalogue.QUERIES["three_way_join"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), EqualTo(l_quantity,50.0)" in plan and "l_tax" not in plan.split("Physical Plan")[1]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
    assert all(name in e.queries() for name in catalogue.QUERIES) and "oracle" in sys.modules
