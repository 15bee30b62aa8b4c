"""CSV with header tags for keys and types.

A header cell is ``name`` with optional tags: ``(P)`` primary key, ``(F)`` foreign key,
``(N)`` number, ``(T)`` text, ``(D)`` date-time kept as text; a leading ``#`` marks a
foreign key whose name ``table_column`` splits at its last underscore.

Types come from the first data row (``(N)``: BIGINT to begin with) and are widened where later rows disagree
(BIGINT to DOUBLE to STRING; integers beyond 64 bits are DOUBLE where a column has only numbers), found by one aggregate over
those columns whose type isn't settled by a tag, rather than by collecting the file. A declared ``schema`` saves that pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"\s*\(([A-Za-z])\)")
_INT = r"^-?[0-9]+$"
_FLOAT = r"^-?[0-9]*\.[0-9]+$|^-?[0-9]+\.[0-9]*$"
_BOOL = r"^(?i:true|false)$"
#: What a missing or malformed cell becomes in lenient mode.
_DEFAULTS = {"bigint": 0, "double": 0.0, "boolean": False, "string": ""}


def parse_header(cell: str, table: str) -> tuple[str, dict]:
    """Clean column name and metadata (pk, fk, ref_table, ref_column, tags) of a header cell."""
    tags = [t.upper() for t in _TAG.findall(cell)]
    name = _TAG.sub("", cell).strip()
    meta: dict = {"tags": tags, "pk": "P" in tags, "fk": "F" in tags, "table": table}
    if name.startswith("#"):
        name = name[1:]
        ref_table, _, ref_column = name.rpartition("_")
        meta |= {"fk": True, "ref_table": ref_table, "ref_column": ref_column}
    return name, meta


def infer_type(value: str | None) -> str:
    """Type of one cell: bigint, double, boolean or string; empty counts as string."""
    if value is None or value == "":
        return "string"
    if re.match(_INT, value) and -(2**63) <= int(value) < 2**63:
        return "bigint"
    if re.match(_FLOAT, value):
        return "double"
    return "boolean" if re.match(_BOOL, value) else "string"


def _raw(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST")
        .option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", True).csv(path)
    )


def table_schema(spark: SparkSession, path: str, table: str, schema: dict[str, str] | None = None) -> tuple[list[str], list[str], list[dict]]:
    """Names, types and metadata of a CSV file; reads the header, the first row and one aggregate over columns of open type.

    ``schema`` declares types (bigint, double, boolean, string) by column name. An empty or header-only file raises ``ValueError``.
    """
    head = spark.read.option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", True).csv(path).limit(2).collect()
    if len(head) < 2:
        raise ValueError(f"{path}: a table needs a header and at least one row")
    if any(v is None for v in head[0]):
        raise ValueError(f"{path}: header and first row differ in length")
    names, metas = zip(*[parse_header(str(c), table) for c in head[0]], strict=True)
    kinds = []
    for name, meta, value in zip(names, metas, head[1], strict=True):
        if name in (schema or {}):
            if schema[name] not in _DEFAULTS:
                raise ValueError(f"{path}: column {name} can't have type {schema[name]!r}")
            kinds.append((schema[name], False))
        elif "T" in meta["tags"] or "D" in meta["tags"]:
            kinds.append(("string", False))
        else:
            kinds.append(("bigint" if "N" in meta["tags"] else infer_type(value), True))
    fits = []
    for i, (kind, free) in enumerate(kinds):
        c = F.col(f"c{i}")
        blank = c.isNull() | (c == "")
        if free and kind == "bigint":
            fits.append(F.bool_and(blank | c.rlike(_INT) & c.try_cast("bigint").isNotNull()).alias(f"bigint{i}"))
        if free and kind in ("bigint", "double"):
            fits.append(F.bool_and(blank | c.rlike(f"{_INT}|{_FLOAT}")).alias(f"double{i}"))
        if free and kind == "boolean":
            fits.append(F.bool_and(blank | c.rlike(_BOOL)).alias(f"boolean{i}"))
    ok = _raw(spark, path, list(names)).agg(*fits).first().asDict() if fits else {}
    wider = {"bigint": ("bigint", "double", "string"), "double": ("double", "string"), "boolean": ("boolean", "string"), "string": ("string",)}
    return list(names), [next(k for k in wider[kind] if k == "string" or ok[f"{k}{i}"] is not False) if free else kind for i, (kind, free) in enumerate(kinds)], list(metas)


def read_csv(spark: SparkSession, path: str, table: str, lenient: bool = False, schema: dict[str, str] | None = None) -> DataFrame:
    """A typed DataFrame of a tagged CSV file.

    Empty cells are null; ``lenient`` turns missing and malformed cells into 0, 0.0, false
    or "". A row with too many or too few fields fails the read. Key tags are kept in
    ``df.schema[...].metadata``.
    """
    names, kinds, metas = table_schema(spark, path, table, schema)
    raw = _raw(spark, path, names)
    columns = []
    for i, (name, kind, meta) in enumerate(zip(names, kinds, metas, strict=True)):
        cell = F.when(F.col(f"c{i}") == "", None).otherwise(F.col(f"c{i}"))
        typed = cell if kind == "string" else cell.try_cast(kind)
        if lenient:
            typed = F.coalesce(typed, F.lit(_DEFAULTS[kind]))
        columns.append(typed.alias(name, metadata=meta))
    return raw.select(*columns)
