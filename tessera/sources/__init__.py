"""Sources and sinks: tagged CSV, Parquet folders, result files."""

from tessera.sources.csv_source import read_csv, table_schema
from tessera.sources.parquet_source import read_tables, register_tables
from tessera.sources.sinks import format_table, result_columns, write_result

__all__ = ["format_table", "read_csv", "read_tables", "register_tables", "result_columns", "table_schema", "write_result"]
