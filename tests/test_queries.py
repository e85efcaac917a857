"""Each registered query equals its SQL on the sample tables where every rule fires."""

from __future__ import annotations

import pytest
from compare import compare, duck

import __spark_entry__ as entry_points
from lanepulse.plans import oracle, registry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert registry.queries().keys() == oracle.oracle_sql().keys()


@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) == []


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
