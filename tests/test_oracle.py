"""Every registered query against its DuckDB text, row for row."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
# Queries of the sales mart; those of the training-data operators have tests of their own.
OWN = set(registry._registry())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert OWN <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    want_columns, want = compare.duck_rows(duck, ORACLE[name])
    columns, got = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    assert columns == want_columns
    assert got == want


def test_entry(spark):
    assert registry.entry(spark).count() > 0
