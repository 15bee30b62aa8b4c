"""The five aggregates, with SUM and AVG always DOUBLE; booleans count as 1 and 0 there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aggregate_column(kind: str, column: str | None = None, boolean: bool = False) -> Column:
    """COUNT, SUM, AVG, MIN or MAX over ``column`` (``None`` or ``*``: COUNT of rows); ``boolean`` says that it is one.

    SUM of integers is cast after summing, so it stays exact up to 2**63 before the cast.
    """
    kind = kind.lower()
    if kind == "count":
        return F.count(F.lit(1)) if column in (None, "*") else F.count(column)
    if column in (None, "*"):
        raise ValueError(f"{kind} needs a column")
    number = F.col(column).cast("int") if boolean else F.col(column)
    if kind == "sum":
        return F.sum(number).cast("double")
    if kind == "avg":
        return F.avg(number)
    if kind in ("min", "max"):
        return getattr(F, kind)(column)
    raise ValueError(f"unknown aggregate {kind!r}")
