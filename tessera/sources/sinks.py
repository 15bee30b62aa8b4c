"""Result sinks: CSV folders on any store, one CSV file for a caller, console table."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_columns(df: DataFrame) -> list[Column]:
    """Text form of a result: doubles with two decimals, TRUE/FALSE, null and "" as NULL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            text = F.format_string("%.2f", c)
            text = F.when(c.isNull(), None).otherwise(text)
        elif kind == "boolean":
            text = F.upper(c.cast("string"))
        else:
            text = c.cast("string")
        out.append(F.when(text.isNull() | (text == ""), "NULL").otherwise(text).alias(name))
    return out


def write_result(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a result as CSV.

    The default writes a folder of part files in parallel, on any store. ``single_file``
    streams rows through the driver, partition by partition, into one local file: that is
    what the batch runner does with its reports.
    """
    text = df.select(*result_columns(df))
    if not single_file:
        text.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
        return
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(text.columns)
        writer.writerows(text.toLocalIterator(prefetchPartitions=True))


def format_table(df: DataFrame, max_rows: int = 1000) -> Iterator[str]:
    """Lines of a console table; columns are at least ten wide, the footer counts the rows shown."""
    widths = [max(len(c), 10) for c in df.columns]
    yield " | ".join(c.ljust(w) for c, w in zip(df.columns, widths, strict=True))
    yield "-+-".join("-" * w for w in widths)
    shown = 0
    for row in df.select(*result_columns(df)).limit(max_rows + 1).toLocalIterator():
        if shown == max_rows:
            yield f"... (first {max_rows} rows)"
            break
        yield " | ".join(str(v).ljust(w) for v, w in zip(row, widths, strict=True))
        shown += 1
    yield f"({shown} rows)"
