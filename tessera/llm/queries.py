"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_format, exact_dedup, language_id, mixing, near_dedup, quality_rules, sentence_spans, sentencepiece_codec, suffix_dedup, url_filter
from tessera.llm.common import read

#: Where the vocabulary file is, unless the session names another in tessera.piece.model.
MODEL = "piece_bpe_32k.model"


def piece_model(spark: SparkSession) -> bytes:
    """The tokenizer model, from the path in tessera.piece.model or from the installed public tokenizers."""
    path = spark.conf.get("tessera.piece.model", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return sentencepiece_codec.load_model(path)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the language-model ratio, over all pages."""
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one made of control strings, and reads the result back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = chat_format.HOSTILE
    hostile = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat_format.chat_digest(turns.unionByName(hostile))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    book = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 costs over all documents."""
    return quality_rules.ablation(quality_rules.ledger(read(spark, sf_dir, "documents")), "v1")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences of repeated spans."""
    return sentence_spans.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 1, 2, 3."""
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of repeated 100-byte strings."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return language_id.identify(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents."""
    return sentencepiece_codec.digest(read(spark, sf_dir, "documents"), piece_model(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline, which imports this module and so is imported when the query runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
    "pipeline": pipeline,
    "quality_ablation": quality_ablation,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat_format.CHAT_SQL,
    "op3_quality_rules": quality_rules.QUALITY_SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
    "op4_sentence_spans": sentence_spans.SPANS_SQL,
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""",
    "op7_mixing": mixing.MIX_SQL,
}
