"""Every registered query against its SQL, and the driver's contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from registered import oracle, plans
from tests.compare import difference, duck, duck_rows, spark_rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_each_query_has_sql():
    assert set(plans.registered()) == set(oracle.registered())
    assert set(plans.registered()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.registered()))
def test_matches_sql(spark, con, name):
    mine = spark_rows(entry.queries()[name](spark, SF_DIR))
    assert difference(mine, duck_rows(con, entry.oracle_sql()[name])) is None
