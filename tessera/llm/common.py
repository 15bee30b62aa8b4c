"""Shared pieces of the training-data operators: intermediate tables, row identities and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch to Python; long texts make larger batches too heavy.
BATCH_ROWS = 256
#: What stands for a null id: smaller than all others.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; on a cluster it is an error, as a
    folder of one machine would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tessera.shared.dir", folder)
    return f"{folder.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the unread part of this table,
    and rows that depend on task order are the same for every later reader.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Delete the tables that this application wrote; only when results that read them are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded row count, which Spark takes from the session alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(function, schema)


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def long_id() -> Column:
    """The id as a number, NO_ID if null."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether any two rows share an id; ids alone are shuffled."""
    return not docs.groupBy(long_id().alias("id")).count().filter("count > 1").isEmpty()


def identified(docs: DataFrame) -> DataFrame:
    """row, id (NO_ID if null), sha and text of every row.

    ``row`` names id and text together: it is the id where no two rows share one (``sha`` is null then), otherwise a number in the
    order of ids and of the texts' hashes. Rows that repeat id and text have one number.
    """
    rows = docs.select(long_id().alias("id"), text_or_empty().alias("text"))
    if not ids_repeat(docs):
        return rows.select(F.col("id").alias("row"), "id", F.lit(None).cast("string").alias("sha"), "text")
    rows = rows.withColumn("sha", F.sha2("text", 256))
    numbers = rows.select("id", "sha").distinct().orderBy("id", "sha").withColumn("row", F.monotonically_increasing_id())
    return written(rows.join(written(numbers, "row-numbers"), ["id", "sha"]).select("row", "id", "sha", "text"), "numbered-texts")


def keep_rows(docs: DataFrame, kept: DataFrame, sha: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``kept`` (id, sha) names; of rows that share id and ``sha`` one is taken.

    ``sha`` is the hash of a row's text, by default of the text as it is. Rows go by id alone, and texts travel once,
    where no two rows of ``docs`` share an id.
    """
    kept = written(kept.select(F.col("id").alias("__id"), F.col("sha").alias("__sha")), "kept")
    by_id = long_id() == F.col("__id")
    shared = written(docs.groupBy(long_id().alias("__id")).count().filter("count > 1").select("__id"), "shared-ids")
    if shared.isEmpty():
        return docs.join(kept, by_id, "left_semi")
    plain = docs.join(shared, by_id, "left_anti").join(kept, by_id, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy("__own"))
    alike = docs.join(shared, by_id, "left_semi").withColumn("__own", F.sha2(text_or_empty(), 256) if sha is None else sha)
    alike = alike.withColumn("__n", first).filter("__n = 1").join(kept, by_id & (F.col("__own") == F.col("__sha")), "left_semi")
    return plain.unionByName(alike.drop("__own", "__n"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
