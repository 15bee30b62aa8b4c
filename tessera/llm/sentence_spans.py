"""Substring deduplication by sliding spans of consecutive sentences.

A text is cut into sentences without losing a character, and long sentences at their clause marks, so that
a passage set into the middle of other sentences still has whole units: signs up to one of
``. ! ? , ; :`` or a line end, with the marks and white space behind it. At every unit a run begins: the fewest
consecutive units, RUN at least, that have LEAST characters together. So runs depend on nothing but what
stands in them, and equal passages have equal runs wherever they stand. Every run is hashed to 128
bits (units as they are, but for white space at their ends), equal hashes meet over all documents, and each unit
that a run other than the first of its kind covers is removed. First is the smallest place: id, then
position. Runs are judged on the input.

Hashes and positions alone are shuffled, once. A task passes on only the first of the runs that are equal
within it, the others are marks already, so a run that many documents share reaches its owner as a few
rows a task. Marks then meet the texts by row.

Null text counts as empty and has no units. Texts of any length are taken whole. Rows that repeat id
and text count as one place, so none of them loses a unit to the other's equal position; rows of one id, or of none, with
different texts are documents of their own, ordered by a hash of the text. A null id comes before all
others. Columns besides doc_id and text are kept by ``remove_repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, identified, ids_repeat, long_id, text_or_empty, written

#: Units in a run, and characters of a run, at least.
RUN, LEAST = 2, 160
#: A unit: what comes before a mark or line end, and all marks and white space behind it.
UNIT = r"[^.!?,;:\n]*[.!?,;:\n][.!?,;: \t\n\r\f\x0b]*|[^.!?,;:\n]+"
BLANK = " \t\n\r\f\x0b"
#: Runs that a task compares before it passes them on.
HELD = 1 << 20
_units = re.compile(UNIT).findall
_M = 0x9E3779B97F4A7C15
_PLACES = ["h1", "h2", "row", "at", "n"]


class _Powers:
    """Powers of the hash multiplier and of its inverse, as far as any text needed them."""

    up = down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            ones = np.ones(2 * n, dtype=np.uint64)
            ones[1:] = np.uint64(_M)
            self.up = np.cumprod(ones)
            ones[1:] = np.uint64(pow(_M, -1, 1 << 64))
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def runs(text: str, run: int = RUN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, number of units and hash (two numbers) of every run of a text."""
    units = [u.strip(BLANK) for u in _units(text)]
    n = len(units)
    total = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=n), out=total[1:])
    ends = np.searchsorted(total, total[:-1] + least)
    at = np.flatnonzero(ends <= n)
    ends = np.maximum(ends[at], at + run)
    at, ends = at[ends <= n], ends[ends <= n]
    if not len(at):
        return at, at, np.zeros((0, 2), dtype=np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, units)), dtype="<u8").reshape(n, 2)
    up, down = _POWERS.get(n)
    prefix = np.zeros((n + 1, 2), dtype=np.uint64)
    np.cumsum(own * down[:, None], axis=0, dtype=np.uint64, out=prefix[1:])
    return at, ends - at, (prefix[ends] - prefix[at]) * up[at, None]


def _firsts(c: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of h1, h2, row, at, n: the first place of each kind, and all that are not of that place."""
    order = np.lexsort((c[3], c[2], c[1], c[0]))
    c = [x[order] for x in c]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (c[2] != c[2][head]) | (c[3] != c[3][head])
    return [x[new] for x in c], [x[later] for x in c]


def _merged(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that overlap or touch within a row as one."""
    order = np.lexsort((at, row))
    row, at, n = row[order], at[order].astype(np.int64), n[order].astype(np.int64)
    shift = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) * (1 << 40)
    end = np.maximum.accumulate(at + n + shift)
    head = np.flatnonzero(np.concatenate([[True], (at + shift)[1:] > end[:-1]]))
    last = np.concatenate([head[1:], [len(at)]]) - 1
    return row[head], at[head], end[last] - shift[last] - at[head]


def _batches(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(c[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in c], _PLACES[-len(c) :])


def _send(run: int, least: int):
    """Map side: first runs with their hash, and marks, which have none."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        first, later = _firsts([np.concatenate(x) for x in held])
        yield from _batches([first[0].view(np.int64), first[1].view(np.int64), *first[2:]])
        if len(later[0]):
            for b in _batches(list(_merged(*later[2:]))):
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *b.columns], _PLACES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in _PLACES], 0
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n, h = runs(text, run, least)
                if len(at):
                    for x, y in zip(held, (h[:, 0], h[:, 1], np.full(len(at), row, dtype=np.int64), at, n), strict=True):
                        x.append(y)
                    size += len(at)
            if size > HELD:
                yield from flush(held)
                held, size = [[] for _ in _PLACES], 0
        if size:
            yield from flush(held)

    return send


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of some hashes: every run but the first of its kind becomes a mark; marks pass through."""
    held: list[list[np.ndarray]] = [[] for _ in _PLACES]
    for b in batches:
        known = np.asarray(b.column(0).is_valid())
        if not known.all():
            yield from _batches([b.column(i).to_numpy()[~known] for i in (2, 3, 4)])
        for i, x in enumerate(held):
            x.append(b.column(i).to_numpy(zero_copy_only=False)[known].astype(np.int64))
    if held[0]:
        _, later = _firsts([np.concatenate(x) for x in held])
        if len(later[0]):
            yield from _batches(list(_merged(*later[2:])))


def repeats(rows: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """row, at and n: runs of units that are to go, of (row, text)."""
    sent = arrow_map(rows.select("row", "text"), _send(run, least), "h1 long, h2 long, row long, at long, n long")
    owner = F.when(F.col("h1").isNull(), F.xxhash64("row", "at")).otherwise(F.col("h1"))
    return arrow_map(sent.repartition(owner), _own, "row long, at long, n long")


def remove_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """``docs`` without repeated spans: its columns, with n_sentences (units of the text) and n_removed behind them.

    Columns of ``docs`` that have the names of these two are replaced.
    """
    found = repeats(identified(docs), run, least)
    found = written(found.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("at", "n")).alias("__marks")), "sentence-repeats")
    keep = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    packed = docs.select(long_id().alias("__row"), text_or_empty().alias("__text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__all"))
    if ids_repeat(docs):
        numbers = written(identified(docs).select(F.col("row"), F.col("id"), F.col("sha")).distinct(), "row-numbers")
        packed = packed.withColumn("__sha", F.sha2("__text", 256)).join(numbers, (F.col("__row") == F.col("id")) & (F.col("__sha") == F.col("sha")))
        packed = packed.select(F.col("row").alias("__row"), "__text", "__all")
    df = packed.join(found, "__row", "left")
    # Cut behind the shuffle, so that texts travel once and without their units.
    df = df.withColumn("__units", F.regexp_extract_all("__text", F.lit(UNIT), F.lit(0)))
    n = F.size("__units")
    covered = F.flatten(F.transform("__marks", lambda m: F.sequence(m["at"], m["at"] + m["n"] - 1))).cast("array<int>")
    df = df.withColumn("__left", F.when(F.col("__marks").isNotNull(), F.array_sort(F.array_except(F.sequence(F.lit(0), n - 1), covered))))
    cut = F.array_join(F.transform("__left", lambda i: F.get("__units", i)), "")
    text = F.when(F.col("__left").isNull(), F.col("__all.text")).otherwise(cut)
    removed = F.when(F.col("__left").isNull(), 0).otherwise(n - F.size("__left"))
    return df.select(
        *[text.alias("text") if c == "text" else F.col("__all")[c].alias(c) for c in keep],
        n.cast("bigint").alias("n_sentences"), removed.cast("bigint").alias("n_removed"),
    )


SPANS_SQL = f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?,;:\\n]*[.!?,;:\\n][.!?,;: \\t\\n\\r\\f\\x0b]*|[^.!?,;:\\n]+') AS s FROM documents),
t AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) FOR x IN s] AS s FROM d),
u AS (SELECT doc_id, pos, length(s[pos]) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM t)),
c AS (SELECT doc_id, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM u),
e AS (SELECT doc_id, total, min(pos) AS pos FROM c GROUP BY doc_id, total),
b AS (
  SELECT c.doc_id, c.pos, greatest(e.pos, c.pos + {RUN - 1}) AS last
  FROM c ASOF JOIN e ON c.doc_id = e.doc_id AND c.total - c.n + {LEAST} <= e.total),
r AS (SELECT b.doc_id, b.pos, b.last, array_to_string(t.s[b.pos:b.last], chr(0)) AS k FROM b JOIN t USING (doc_id) WHERE b.last <= len(t.s)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS i FROM r),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, last + 1)) AS p FROM f WHERE i > 1) GROUP BY doc_id),
p AS (SELECT d.doc_id, d.text, d.s, gone, [i FOR i IN range(1, len(s) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS keep FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([s[i] FOR i IN keep], '') END AS text,
       len(s) AS n_sentences, len(s) - len(keep) AS n_removed
FROM p
"""
