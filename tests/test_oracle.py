"""Every report against DuckDB SQL over the same star tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from tallyglass.plans.reports import REPORTS

STAR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(STAR)


def test_every_report_has_sql():
    assert set(REPORTS) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_report(spark, duck, name):
    assert differences(QUERIES[name](spark, STAR), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() == 9
