"""Projection, filter, join, ungrouped aggregates, sort and subqueries.

Every function builds a logical plan and returns at once; Catalyst prunes columns,
pushes filters to the scan and picks the join strategy. Nothing here caches,
collects or repartitions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import aggregate_column, all_of, compare_columns


def project(df: DataFrame, *columns: str | Column, **aliases: str) -> DataFrame:
    """Columns in the given order, then ``alias="column"`` pairs; none means all columns."""
    if not columns and not aliases:
        return df.select("*")
    return df.select(*columns, *[F.col(c).alias(a) for a, c in aliases.items()])


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is true; null counts as false."""
    return df.filter(all_of(*conditions))


def theta_join(left: DataFrame, right: DataFrame, *conditions: Column, how: str = "inner") -> DataFrame:
    """Join on any boolean conditions.

    Equalities become a hash or sort-merge join with the other conditions as residue.
    Without an equality Spark has to compare all pairs, so at least one side of a pure
    inequality join must be small; that is why a join without condition is refused.
    """
    if not conditions:
        raise ValueError("a join needs a condition; use DataFrame.crossJoin for all pairs")
    return left.join(right, all_of(*conditions), how)


def cell_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *conditions: Column, rows: int = 2048) -> DataFrame:
    """Inner join on a key of few values, and on ``conditions``, where each key has many rows on both sides.

    A plain join hands a key to one task. Here a key's rows are dealt into chunks of about ``rows`` on either side, and every pair of chunks is a cell that
    some task joins: all pairs are made, and a task holds one chunk at a time. A row is sent once for each chunk opposite, that is
    2 / ``rows`` rows a pair compared. The counts are one row a key and are broadcast, so the key must have few values; for others :func:`theta_join` does.

    Chunks are told by a hash of the row's own columns, so a task that runs again sends the same rows; equal rows share a chunk. Select the needed columns before.
    """

    def keys(df: DataFrame, key: str, n_left: int, n_right: int) -> DataFrame:
        return df.select(F.col(key).alias("__key"), F.lit(n_left).alias("__left"), F.lit(n_right).alias("__right"))

    counts = keys(left, left_key, 1, 0).unionAll(keys(right, right_key, 0, 1)).groupBy("__key").agg(F.sum("__left").alias("__left"), F.sum("__right").alias("__right"))
    counts = counts.filter("__left > 0 AND __right > 0").select("__key", *[F.ceil(F.col(c) / rows).alias(c) for c in ("__left", "__right")])

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes make many pairs, and adaptive execution would merge by bytes

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        dealt = df.join(F.broadcast(counts), F.col(key) == F.col("__key"))
        chunk = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(own))
        cells = dealt.withColumns({own: chunk, other: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))})
        return cells.drop("__key").repartition(tasks, F.col(key), F.col("__left"), F.col("__right"))

    right = dealt(right, right_key, "__right", "__left").withColumnsRenamed({"__left": "__left_2", "__right": "__right_2"})
    same_cell = all_of(compare_columns(left_key, "=", right_key), compare_columns("__left", "=", "__left_2"), compare_columns("__right", "=", "__right_2"))
    joined = dealt(left, left_key, "__left", "__right").join(right.hint("merge"), all_of(same_cell, *conditions))
    return joined.drop("__left", "__right", "__left_2", "__right_2")


def _aggregate(df: DataFrame, kind: str, column: str | None) -> Column:
    boolean = column not in (None, "*") and kind.lower() in ("sum", "avg") and df.select(column).dtypes[0][1] == "boolean"
    return aggregate_column(kind, column, boolean)


def global_agg(df: DataFrame, aggregates: dict[str, tuple[str, str | None]], empty: str = "row") -> DataFrame:
    """One row of aggregates: ``{"total": ("sum", "price"), "n": ("count", None)}``.

    Over no rows the result is SQL's single row (COUNT 0, the rest null);
    ``empty="no_row"`` gives no row instead.
    """
    if empty not in ("row", "no_row"):
        raise ValueError("empty must be 'row' or 'no_row'")
    columns = [_aggregate(df, *spec).alias(name) for name, spec in aggregates.items()]
    if empty == "row":
        return df.agg(*columns)
    return df.agg(*columns, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")


def sort_by(df: DataFrame, *keys: str | tuple[str, str], tie_breaker: str | None = None) -> DataFrame:
    """Order by ``"col"`` or ``("col", "desc")``; nulls first ascending, last descending.

    Keys are columns: a constant would order nothing and is refused. Spark's sort isn't stable: name a unique ``tie_breaker`` where the order of ties matters.
    """
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    if tie_breaker:
        pairs.append((tie_breaker, "asc"))
    for key, way in pairs:
        if not isinstance(key, str) or key not in df.columns and re.fullmatch(r"\s*(-?[\d.]+|'.*'|\".*\")\s*", key):
            raise ValueError(f"a sort key must be a column, not {key!r}")
        if way.lower() not in ("asc", "desc"):
            raise ValueError(f"sort direction must be asc or desc, not {way!r}")
    return df.orderBy(*[F.col(c).desc() if way.lower() == "desc" else F.col(c).asc() for c, way in pairs])


def vs_global_agg(df: DataFrame, column: str, op: str, kind: str, over: str | None = None) -> DataFrame:
    """Rows whose ``column`` compares with an aggregate over all rows of ``df``.

    The aggregate is one row by construction, so broadcasting it is bounded at any scale;
    a global window would send all rows to one task instead.
    """
    one = df.agg(_aggregate(df, kind, over or column).alias("__agg"))
    joined = df.join(F.broadcast(one), compare_columns(F.col(column), op, F.col("__agg")), "inner")
    return joined.drop("__agg")


def derived(df: DataFrame, alias: str | None = None) -> DataFrame:
    """A derived table: the plan itself, under ``alias`` if one is given; nothing is registered."""
    return df.alias(alias) if alias else df


def scalar_lookup(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, kind: str, column: str, name: str) -> DataFrame:
    """Correlated scalar aggregate in the select list: aggregate ``inner`` by key, left join.

    The inner side is reduced to one row a key before the join, so no row of ``outer`` multiplies. A key without rows gives what SQL
    gives: 0 for ``count``, null for the others.
    """
    agg = inner.groupBy(F.col(inner_key).alias("__key")).agg(_aggregate(inner, kind, column).alias("__agg"))
    joined = outer.join(agg, F.col(outer_key) == F.col("__key"), "left")
    value = F.coalesce("__agg", F.lit(0).cast("bigint")) if kind.lower() == "count" else F.col("__agg")
    return joined.withColumn(name, value).drop("__key", "__agg")
