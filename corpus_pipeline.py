"""A training corpus from raw documents: rules, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage reads what the one before it wrote. All stages take texts of
any length whole, and all but the last return every column of ``docs`` and no other, whatever the columns are
called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from tessera.llm.common import read, written
from tessera.llm.queries import piece_model

#: No SQL: near deduplication hashes shingles and byte-pair merges have no SQL form. Tests compare
#: run() with a plain version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1. Measurements stay beside the text, so nothing is shuffled.

    Null and empty texts have no words and go. Each row is judged by itself, so repeated rows share a verdict.
    """
    return quality_rules.passing(docs, "v1")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id.

    Null text counts as empty, and one of all empty texts stays. A null id is smaller than any other; of rows that repeat id and text one stays.
    """
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the smallest id.

    Texts without words, null ones included, equal each other. A null id is the smallest; of rows that repeat id and text one stays,
    rows of one id with different texts go by their texts.
    """
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document taken in several epochs has several rows.

    Null source is a source of its own. Documents without words are taken in no epoch. Ties and repeated rows are ordered by all their columns.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids, spans and decoded text of every row of the mix.

    Null text counts as empty and has begin and end id alone. Each row is encoded by itself.
    """
    return sentencepiece_codec.digest(docs, piece_model(spark))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again but the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", *[F.col(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")])
