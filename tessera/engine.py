"""The engine: a catalog of tables and a single-SELECT SQL front door."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import derived
from tessera.sources import read_csv, register_tables

#: A quoted literal or name, or a comment; only comments are blanked, and only to look at the statement's first words.
_TOKEN = re.compile(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`)|--[^\n]*|/\*.*?\*/""", re.S)


def _without_end(text: str) -> str:
    """The statement without a semicolon that stands outside literals and comments."""
    ends = [m.start() for m in re.finditer(_TOKEN.pattern + "|;", text, re.S) if m[0] == ";"]
    return text[: ends[0]] if ends else text


class Engine:
    """Loads tables into the session catalog and answers one SELECT at a time."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load_csv(self, path: str, table: str | None = None, lenient: bool = False) -> DataFrame:
        """Register a tagged CSV file under ``table``, by default the file's stem; types are inferred anew."""
        name = table or PurePosixPath(path).stem
        df = read_csv(self.spark, path, name, lenient)
        df.createOrReplaceTempView(name)
        return df

    def load_folder(self, folder: str, lenient: bool = False) -> list[str]:
        """Register every ``*.csv`` of a folder, listed through Hadoop so that any store works."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = sorted(s.getPath().toString() for s in fs.listStatus(hadoop) if s.getPath().getName().endswith(".csv"))
        for path in paths:
            self.load_csv(path, lenient=lenient)
        return [PurePosixPath(p).stem for p in paths]

    def load_parquet(self, folder: str, *names: str) -> None:
        """Register Parquet tables ``folder/name.parquet``."""
        register_tables(self.spark, folder, names) if names else register_tables(self.spark, folder)

    def register(self, name: str, df: DataFrame) -> None:
        """Register a DataFrame as table ``name``."""
        df.createOrReplaceTempView(name)

    def tables(self) -> list[str]:
        """Names of the registered tables, sorted."""
        return sorted(t.name for t in self.spark.catalog.listTables())

    def has_table(self, name: str) -> bool:
        """Whether ``name`` is registered."""
        return self.spark.catalog.tableExists(name)

    def table(self, name: str) -> DataFrame:
        """The registered table."""
        return self.spark.table(name)

    def describe(self, name: str) -> list[tuple[str, str, str]]:
        """(column, type, keys) of a table; keys reads like ``PK`` or ``FK -> table.column``."""
        out = []
        for field in self.table(name).schema.fields:
            m = field.metadata or {}
            keys = ["PK"] if m.get("pk") else []
            if m.get("fk"):
                keys.append(f"FK -> {m['ref_table']}.{m['ref_column']}" if "ref_table" in m else "FK")
            out.append((field.name, field.dataType.simpleString(), ", ".join(keys)))
        return out

    def sql(self, text: str, empty_agg: str = "row") -> DataFrame:
        """The DataFrame of one SELECT (or WITH ... SELECT) statement.

        Anything else is refused before Spark sees it. ``empty_agg="no_row"`` drops the
        single row that a global aggregate gives over no input rows: the statement's own
        rows are kept only if its input has any, so use it for ungrouped aggregates alone.
        """
        bare = _TOKEN.sub(lambda m: "''" if m[1] else " ", text).strip().rstrip(";").strip()
        if not re.match(r"(?i)(select|with)\b", bare):
            raise ValueError("only SELECT statements are supported")
        if empty_agg not in ("row", "no_row"):
            raise ValueError("empty_agg must be 'row' or 'no_row'")
        df = self.spark.sql(text)
        if empty_agg == "no_row":
            if re.search(r"(?i)\bhaving\b|\bgroup\s+by\b|\border\s+by\b", bare):
                raise ValueError("empty_agg='no_row' is for plain ungrouped aggregates")
            df = self.spark.sql(f"{_without_end(text)}\nHAVING COUNT(*) > 0")
        return derived(df)
