"""Mixing sources to target weights.

Every document gets a hash-random key, sources are cut into fixed ranges of that key, the
sums of the ranges and the order within a range give exact prefix sums, and a source is cut
where its word budget ends; budgets beyond a source's size repeat it in whole epochs.

A source of any size spreads over RANGES ranges, so no task holds a whole source. Keys
depend on the id alone, so reruns agree. Rows that repeat an id are ordered by size, so they take
the same numbers of words in every run; in the mix itself they go by all their columns.

Null text has size 0, null source is a source of its own and the last. Documents of size 0
take nothing. With no words at all, all targets are 0. Texts of any length are taken whole. Only doc_id, source and text are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, ids_repeat, long_id, text_or_empty, written

#: Key ranges a source is cut into: the first three hex digits of the key.
RANGES = 16**3


def word_count(column: str = "text") -> Column:
    """Words in the text, null: none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """source, rank, source_size and target of each source.

    Targets share the total by weight but stop at ``cap`` times the source's size. Resharing
    the excess until none is above ends at a level L with target = min(cap * size, L * weight):
    in order of cap * size / weight, L is the first level that the next source doesn't fall short of.
    The windows run over one row a source, in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("rank")
    ranked = by_source.select("source", "source_size", rank)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", weight.alias("w"), (cap * F.col("source_size")).alias("most"))
    ranked = ranked.withColumn("fullness", F.col("most") / F.col("w"))
    before = Window.orderBy("fullness", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("fullness", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("fullness", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    ranked = ranked.withColumn("level_here", rest.cast("double") / F.sum("w").over(after))
    level = F.min(F.when(F.col("level_here") <= F.col("fullness"), F.struct("fullness", "rank", "level_here"))).over(everything)
    ranked = ranked.withColumn("level", level["level_here"])
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("w"))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row a row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the document's words in the mix, repeats included: whole epochs, plus the
    document's part of the last epoch, which ends exactly at the budget (the target's whole words).
    """
    sizes = written(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return _takings(sizes, weights, cap, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def _takings(sizes: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """``sizes`` (doc_id, source, size, and more, by which rows of equal id and size are ordered) with source_size, target and taken."""
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    goals = written(targets(sizes, weights, cap), "mix-targets")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sizes.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("rank", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("rank", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range"))
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, ["rank", "range"])
    rows = rows.withColumn("budget", F.floor("target").cast("bigint"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("bigint"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before_range") - F.col("before")))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + part)


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, with all columns of ``docs``: a row an epoch for each document.

    A document that the budget cuts gives its first words in its last row, and its n_chars follows. Where ids repeat, rows are numbered in
    the order of their ids and of a hash of all their columns, so reruns agree.
    """
    numbered = docs.withColumn("__row", long_id())
    if ids_repeat(docs):
        every = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
        numbered = docs.withColumn("__sha", every).orderBy(long_id(), "__sha").drop("__sha")
        numbered = written(numbered.withColumn("__row", F.monotonically_increasing_id()), "numbered-documents")
    sizes = written(numbered.select("doc_id", "source", word_count().alias("size"), "__row"), "mix-sizes")
    plan = _takings(sizes, weights, cap, seed).filter("taken > 0")
    rows = numbered.join(plan.select("__row", F.col("taken").alias("__taken"), F.col("size").alias("__size")), "__row")
    copies = F.sequence(F.lit(1), F.expr("cast((__taken + __size - 1) div __size AS int)"))
    rows = rows.withColumn("__copy", F.explode(copies))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.concat_ws("", F.slice(pieces, F.lit(1), left.cast("int")))
    rows = rows.withColumn("text", F.when(left >= F.col("__size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(left >= F.col("__size"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sizes GROUP BY source),
w AS (SELECT *, ((rank - 1) % 3) + 1 AS w, 3 * source_size AS most FROM s),
f AS (SELECT *, CAST(most AS DOUBLE) / w AS fullness FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fullness, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY fullness, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level_here
  FROM f),
t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), w * (SELECT level_here FROM l WHERE level_here <= fullness ORDER BY fullness, rank LIMIT 1)) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
