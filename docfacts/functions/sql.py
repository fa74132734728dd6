"""Small helpers for building Spark SQL expressions out of parts.

The functions of this package take and return SQL expression text, for ``F.expr`` and
``selectExpr``. An argument is a column name or any expression. Long higher-order
expressions reach Spark in one call this way, and lambda names never collide.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count()


def fresh() -> str:
    """A lambda variable name not used before, with a prefix that no column has (a lambda name hides a column)."""
    return f"_docfacts_lambda_{next(_names)}"


def literal(text: str) -> str:
    """A string literal, escapes included."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    v = fresh()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def each(array: str, body: Callable[[str], str]) -> str:
    """``body`` of every array entry."""
    v = fresh()
    return f"transform({array}, {v} -> {body(v)})"


def only(array: str, test: Callable[[str], str]) -> str:
    """The array entries that pass ``test``."""
    v = fresh()
    return f"filter({array}, {v} -> {test(v)})"


def each_value(amounts: str, body: Callable[[str], str]) -> str:
    """``body`` of every map value."""
    k, v = fresh(), fresh()
    return f"transform_values({amounts}, ({k}, {v}) -> {body(v)})"
