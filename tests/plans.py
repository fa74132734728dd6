"""What tests ask of query plans."""

from __future__ import annotations


def executed_plan(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
