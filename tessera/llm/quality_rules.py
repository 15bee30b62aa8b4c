"""Quality rules as a bitmask ledger, in Spark expressions only.

Every rule is evaluated once a document into one failure bit, beside the measurements it used.
Policies are versioned bit masks over that ledger: applying another policy, or asking what each
rule alone costs, is bitwise arithmetic over the ledger and never reads a text again.

Null text has no words, no lines and no symbols, and so fails ``few_words``. Texts of any length
are taken whole and stay within their row: nothing is shuffled. Repeated rows get a row each.
Columns of the input besides doc_id and text are ignored, so their names can't clash. An empty table gives an empty result.

Three-word windows are compared by the 64-bit hash of their words; two different windows of one
text share a hash with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, text_or_empty

#: What n_symbols counts, and what stands between words.
SYMBOLS, BLANKS = r"[#*$%&|<>]+", r"[\x20\x09-\x0D]+"
#: Rules by bit: name and the condition under which a document fails, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "4 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
#: The rules that the base verdict consists of.
BASE = ("few_words", "repeated_words")
#: Versioned policies: which rules reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def bit(rule: str) -> int:
    """The rule's bit."""
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(bit(r) for r in POLICIES[policy])


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the ``carry`` columns and the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col("text")
    # array<string> of words, then array<bigint> of the hashes of all three-word windows
    df = docs.select("doc_id", *carry, text_or_empty().alias("text")).withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id",
        *carry,
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        lines.alias("lines"),
    )
    windows = F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))")
    df = df.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("windows"),
    )
    # Only texts with a repeated window pay for the sort that finds where it stands.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("placed", placed).drop("windows")
    same = lambda a, b: F.coalesce(F.get("placed", a)["h"] == b["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("placed", lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))
    df = df.withColumn("starts", starts).drop("placed")
    covered = F.expr("aggregate(transform(starts, (p, j) -> least(3, coalesce(get(starts, j + 1) - p, 3))), 0, (a, x) -> a + x)")
    return df.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the ``carry`` columns, the measurements, and ``fail_bits``: the bit of every rule that the document fails."""
    bits = F.lit(0).cast("bigint")
    for rule, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(bit(rule)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measure(docs, *carry).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns, without a join or shuffle.

    The row number stands between the measurements and the filter: Catalyst pushes no predicate below
    it, and so doesn't put the measurements, many times over, into the condition.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    book = ledger(packed, "__row").select("__row", "fail_bits", F.monotonically_increasing_id().alias("__number"))
    return book.filter(passes(policy) & (F.col("__number") >= 0)).select("__row.*")


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """One row a rule of the policy: failed, failed_alone (that rule only), kept, kept_without.

    All counts come from one pass over the ledger, aggregated in the map tasks first.
    """
    m = F.lit(mask(policy)).cast("bigint")
    hit = F.col("fail_bits").bitwiseAND(m)
    counts = [F.count_if(hit == 0).alias("kept")]
    for rule in POLICIES[policy]:
        b = F.lit(bit(rule)).cast("bigint")
        counts += [F.count_if(hit.bitwiseAND(b) != 0).alias(f"failed_{rule}"), F.count_if(hit == b).alias(f"alone_{rule}")]
    rows = [
        F.struct(
            F.lit(rule).alias("rule"), F.col(f"failed_{rule}").alias("failed"), F.col(f"alone_{rule}").alias("failed_alone"),
            F.col("kept"), (F.col("kept") + F.col(f"alone_{rule}")).alias("kept_without"),
        )
        for rule in POLICIES[policy]
    ]
    return book.agg(*counts).select(F.inline(F.array(*rows)))


QUALITY_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, row_number() OVER () AS r
  FROM documents),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines
  FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept,
       CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
FROM m
"""

ABLATION_SQL = f"""
WITH q AS ({QUALITY_SQL}),
h AS (SELECT fail_bits & {mask("v1")} AS hit FROM q),
r(rule, bit) AS (VALUES {", ".join(f"('{rule}', {bit(rule)})" for rule in POLICIES["v1"])})
SELECT rule, count(*) FILTER (hit & bit <> 0) AS failed, count(*) FILTER (hit = bit) AS failed_alone, count(*) FILTER (hit = 0) AS kept,
       count(*) FILTER (hit = 0 OR hit = bit) AS kept_without
FROM h, r GROUP BY rule
"""
