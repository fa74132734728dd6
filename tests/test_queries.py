"""Every registered query next to its SQL check on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duckdb_views

import __spark_entry__ as entry
from docfacts.plans.oracles import ORACLES
from docfacts.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_all_are_registered():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 200
