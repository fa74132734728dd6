"""Helpers of the tests in this folder."""

from __future__ import annotations


def rows(df, *columns: str) -> list[tuple]:
    """All rows, sorted, as tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
