"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector, drawn by a seeded generator of its code point when it is first seen, so letters
of all scripts have vectors of their own. A trigram binds its three letters, the first permuted
twice and the second once: rho(rho(a)) * rho(b) * c. A document bundles (adds) its trigrams' vectors, a
language prototype bundles those of its training documents, and a document gets the language whose
prototype has the highest cosine with it.

Letters are lower-cased; runs of anything else are one boundary sign with a vector of its own, also put before and after
the text. Sums are exact integers, so the result doesn't depend on the order of rows. Prototypes are learned from all
documents with a language whose crc32(doc_id) mod 5 isn't 0; what reaches the driver is DIMENSIONS numbers a language.
A task remembers at most REMEMBERED trigrams' vectors, and trigram counts of HELD entries while it learns.

A text that is null or without letters gets ``und`` and score 0, as do all when nothing could be
learned. Of equal cosines the first language by code point wins. A null doc_id is not held out and
not learned from. Texts of any length are taken whole. Repeated rows get a row each; columns besides doc_id, text and lang are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map

DIMENSIONS = 1024
#: Trigrams whose vectors a task remembers; distinct trigrams of languages that it holds before it bundles them.
REMEMBERED, HELD = 1 << 16, 1 << 20
SEED = 20
#: Letters of a trigram are 21-bit code points in one number; 0 is the boundary.
_BITS = 21


class Profiles:
    """Letter vectors, and the bound vectors of trigrams, made when first seen."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, dtype=np.int8)  # of code points: 0 not yet seen, 1 no letter, 2 letter
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIMENSIONS), dtype=np.int8)

    def letter(self, point: int) -> np.ndarray:
        """The letter's vector."""
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
        return self.letters[point]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of a text and their counts; None without letters."""
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        kind = self.kinds[c]
        if not kind.all():
            new = np.unique(c[kind == 0])
            self.kinds[new] = [2 if chr(x).isalpha() else 1 for x in new]
            kind = self.kinds[c]
        c = np.concatenate([[0], np.where(kind == 2, c, 0), [0]])
        c = c[np.concatenate([[True], (c[1:] | c[:-1]) != 0])]
        if len(c) < 3:
            return None
        return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:], return_counts=True)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """Bound vectors of distinct trigrams, REMEMBERED at most."""
        ids = ids.tolist()
        new = [x for x in ids if x not in self.rows]
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, new = {}, ids
        if len(self.rows) + len(new) > len(self.table):
            more = np.empty((min(REMEMBERED, 2 * (len(self.rows) + len(new))), DIMENSIONS), dtype=np.int8)
            more[: len(self.table)] = self.table
            self.table = more
        mask = (1 << _BITS) - 1
        for x in new:
            a, b, c = (self.letter(x >> k * _BITS & mask) for k in (2, 1, 0))
            self.table[len(self.rows)] = np.roll(a, 2) * np.roll(b, 1) * c
            self.rows[x] = len(self.rows)
        return self.table[[self.rows[x] for x in ids]]

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, exact up to 2**24 trigrams a text in float32, beyond in float64."""
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        step = min(4096, REMEMBERED)
        return sum(counts[at : at + step].astype(kind) @ self.vectors(ids[at : at + step]).astype(kind) for at in range(0, len(ids), step))


@lru_cache(maxsize=1)
def profiles() -> Profiles:
    """The process's profiles; they are the same everywhere."""
    return Profiles()


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bundles for each language: lang, dimension, sum. Trigram counts are held up to a bound, then bundled."""
    p, counts, size = profiles(), {}, 0
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (found := p.trigrams(text)) is not None:
                counts.setdefault(lang, []).append(found)
                size += len(found[0])
        if size > HELD:
            counts = {lang: [_added(parts)] for lang, parts in counts.items()}
            size = sum(len(parts[0][0]) for parts in counts.values())
            if size > HELD // 2:
                yield from _bundles(p, counts)
                counts, size = {}, 0
    yield from _bundles(p, counts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of several and the sums of their counts."""
    ids, where = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
    total = np.zeros(len(ids), dtype=np.int64)
    np.add.at(total, where, np.concatenate([n for _, n in parts]))
    return ids, total


def _bundles(p: Profiles, counts: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang, parts in counts.items():
        ids, n = _added(parts)
        total = np.zeros(DIMENSIONS, dtype=np.int64)
        for at in range(0, len(ids), 1024):
            total += (n[at : at + 1024].astype(np.float64) @ p.vectors(ids[at : at + 1024]).astype(np.float64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], ["lang", "dim", "n"]
        )


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes as unit vectors."""
    train = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = arrow_map(train.select("text", "lang"), _learn, "lang string, dim int, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()
    langs = sorted(rows["lang"].unique())
    matrix = np.zeros((len(langs), DIMENSIONS))
    matrix[[langs.index(x) for x in rows["lang"]], rows["dim"].to_numpy()] = rows["n"].to_numpy(np.float64)
    return langs, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only the text decides."""
    model = docs.sparkSession.sparkContext.broadcast(prototypes.T.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, columns = profiles(), model.value
        for b in batches:
            named, score = [], []
            for text in b.column(2).to_pylist():
                found = p.trigrams(text) if langs else None
                if found is None:
                    named.append("und")
                    score.append(0.0)
                    continue
                v = p.bundle(*found)
                cos = (v @ columns) / max(float(np.sqrt(v.astype(np.float64) @ v.astype(np.float64))), 1e-12)
                best = int(np.argmax(cos))
                named.append(langs[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns prototypes from the documents outside the held-out fold and predicts all of them."""
    return predict(docs, *learn(docs))
