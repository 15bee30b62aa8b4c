"""Comparison predicates as Catalyst columns.

Nulls follow SQL: a comparison with null is null, and a filter drops the row. Numbers of different types compare as numbers;
a number or boolean against text is an error, found when the plan is built, not a cast that may fail on some row.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
}


def _apply(left: Column, op: str, right: Column, tolerance: float | None) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown comparison operator {op!r}; expected one of {sorted(_OPS)}")
    if tolerance is not None and op in ("=", "==", "!=", "<>"):
        close = F.abs(left - right) < F.lit(float(tolerance))
        return close if op in ("=", "==") else ~close
    return _OPS[op](left, right)


def check_types(df: DataFrame, *columns: str) -> None:
    """Raise ``ValueError`` if the columns can't be compared: text with numbers or booleans, or numbers with booleans."""
    text, kinds = ("string", "char", "varchar"), set()
    for c in columns:
        kind = df.select(c).dtypes[0][1].partition("(")[0]
        kinds.add("text" if kind in text else "boolean" if kind == "boolean" else kind if kind.startswith(("timestamp", "date")) else "number")
    if len(kinds) > 1:
        raise ValueError(f"can't compare {' with '.join(sorted(kinds))}: {', '.join(columns)}")


def compare(column: str | Column, op: str, value, tolerance: float | None = None) -> Column:
    """``column op value``; ``tolerance`` makes (in)equality of doubles approximate.

    The tolerant form is not pushed to the scan and can't key a hash join, so it is
    opt-in and meant for filters on DOUBLE columns alone.
    """
    left = F.col(column) if isinstance(column, str) else column
    return _apply(left, op, F.lit(value), tolerance)


def compare_columns(left: str | Column, op: str, right: str | Column) -> Column:
    """``left op right`` for two columns, of one table or of both sides of a join."""
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    return _apply(left, op, right, None)


def all_of(*conditions: Column) -> Column:
    """Conjunction; no condition at all is true."""
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def any_of(*conditions: Column) -> Column:
    """Disjunction; no condition at all is false."""
    return reduce(operator.or_, conditions) if conditions else F.lit(False)
