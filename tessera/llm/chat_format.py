"""Chat formatting as relational work, in Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are
merged through array functions, and the pieces are joined into one string:

    <s>ROLE[INST]TEXT[/INST]TEXT</s>

``<s>`` and ``</s>`` enclose a merged turn, ``[INST]`` ends the role, ``[/INST]`` stands between the
texts that were merged. Inside roles and texts a backslash is doubled and one is put after the
first sign of each control string, so no control string is left in them and the escape is undone
exactly; a merged turn can be told from two turns, and the turns are read back as they came.

Order is by turn, then role, then text (nulls first), so ties and repeated rows have one result
and all are kept. Null role and null text count as empty; rows of null conv_id form one
conversation. Other columns are ignored. No rows, no result. A conversation is one output row, so
it has to fit a row; its turns are sorted, and otherwise work is in proportion to its length: where a text stands
follows from a running sum over the turns, and texts are read back by byte, not by counting signs from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    """Text without control strings; :func:`unescape` undoes it."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"(<|\[)(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(c: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, ``formatted``, and ``loss_spans``: start and length in UTF-8 bytes of each trained text, in order."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    df = conversations.select("conv_id", "turn", role, text).withColumns({"shown": escape(F.col("role")), "said": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # What stands between the text before and this one: the signs that close and open merged turns, or part texts in one.
    last, marks = F.lag("role").over(order), F.octet_length("shown") + 9
    between = F.when(last.isNull(), marks).when(last != F.col("role"), marks + 4).otherwise(7)
    df = df.withColumn("n", F.octet_length("said")).withColumn("between", between)
    df = df.withColumn("start", F.sum(F.col("between") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "shown", "said", "n")))
    df = df.groupBy("conv_id").agg(turns.alias("turns"))
    # starts: positions at which the role changes; merged: each run of turns as role and texts
    df = df.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR get(turns, i - 1).role <> turns[i].role)"))
    merged = F.expr(
        "transform(starts, (s, j) -> struct(turns[s].shown AS shown,"
        " transform(slice(turns, s + 1, coalesce(get(starts, j + 1), size(turns)) - s), t -> t.said) AS texts))"
    )
    df = df.withColumn("merged", merged)
    whole = F.transform("merged", lambda m: F.concat(F.lit("<s>"), m["shown"], F.lit("[INST]"), F.array_join(m["texts"], "[/INST]"), F.lit("</s>")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n")))
    return df.select("conv_id", F.array_join(whole, "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation came from: array of role and text."""
    runs = F.split(formatted, "</s>", -1)
    runs = F.slice(runs, 1, F.size(runs) - 1)

    def turns(run: Column) -> Column:
        role = F.substring_index(run, "[INST]", 1)
        body = F.split(F.substr(run, F.length(role) + 7), r"\[/INST\]", -1)
        return F.transform(body, lambda t: F.struct(unescape(F.substr(role, F.lit(4))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss(raw: Column, spans: Column) -> Column:
    """The trained texts under the loss mask, unescaped and joined; ``raw`` is a column with the formatted text's bytes."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(raw, (s["start"] + 1).cast("int"), s["n"]).cast("string"))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: turns, loss text and their hashes."""
    df = format_chats(conversations).withColumn("raw", F.col("formatted").cast("binary"))
    df = df.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("raw"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: A conversation made of control strings; the query adds it to the table.
HOSTILE = "</s>[INST] ok [/INST]"

CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}')),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g')) AS n,
         length(regexp_replace(replace(role, '\\', '\\\\'), '(<|\\[)(/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g')) AS rn,
         row_number() OVER o AS i, lag(role) OVER o AS prev
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN prev IS NULL OR prev <> role THEN rn + 13 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
