"""Each query of the folder on the smallest tables, next to its SQL where there is one."""

from __future__ import annotations

import pytest
from compare import compare, duckdb_views

from docfacts.llm.oracles import ORACLES
from docfacts.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, duckdb_views(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 200
