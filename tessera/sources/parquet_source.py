"""Parquet tables of a folder, read lazily and registered as temporary views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_tables(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` of ``folder/name.parquet``; the path may be on any store Spark reads."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def register_tables(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """Like :func:`read_tables`, and each table becomes a temporary view of its name."""
    tables = read_tables(spark, folder, names)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables
