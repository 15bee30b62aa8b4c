"""Near-duplicate groups by Order MinHash and banded alignment.

A document is its sequence of five-word shingles. For each of SKETCHES hash functions, the TUPLE shingles of
least hash, labelled with their occurrence number, are sampled and kept in text order; the hash of that
sequence is the sketch. Documents that share a sketch meet in a bucket.

Two documents are near-duplicates if their shingle sequences align to a similarity of THRESHOLD or more:
aligned shingles / (all shingles of both - aligned shingles), with order kept. The alignment is the longest
common subsequence of the shingles as they are, without labels, inside the band of diagonals that this similarity
allows, where it is exact: an increasing run of places if no shingle repeats, a bit-parallel table otherwise.
Moved blocks lower the similarity, as the method is sensitive to order.

Documents of equal words are one text, and only its first row takes part. Candidates come in three rounds, and each round
leaves out pairs that the rounds before have put into one component:

1. every text with the first text of each of its buckets;
2. every text with the last text of each of its buckets, so that all pairs of buckets of up to three are verified, and in larger
   buckets also with the texts next to it in a random order, which joins most of a crowd;
3. texts of larger buckets, and all texts of up to SHORT shingles, by an exact prefix join: each keeps its
   rarest shingles, as many as two texts at THRESHOLD can't all have apart, and every two texts that share one and
   fit each other in length are verified. So nothing is lost where a bucket was too large to pair all of it,
   nor to the sketches of short texts, which say less.

What is left to chance is that two texts of more than SHORT shingles at the threshold share no sketch: near
(1 - 0.8**5)**40, 1e-7, for texts without repeated shingles. The prefix join makes rows of two different components only;
a shingle of a whole crowd is among the rarest only of texts that have little of their own, so a crowd just
under the threshold, without links, costs a verification for each of its pairs.
Groups are the connected components of all verified links.

Null and empty texts, and texts without words, equal each other. Texts of fewer than five words have one
shingle of all their words. A null id is smaller than all others. Rows that repeat id and text are one document; rows of one id, or
of none, with different texts are documents of their own. Texts of any length are taken whole; where shingles repeat, time for a
verification grows with the product of both lengths. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, WORD, arrow_map, identified, keep_rows, written

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, TUPLE = 40, 5
#: Texts of so many shingles at most always take part in the exact join.
SHORT = 30
#: Rarer shingles of its text that a row of the exact join carries, to tell pairs that have met already.
EARLIER = 32
#: Slots of the shingle counts that order shingles by rarity. Collisions change the order, never the pairs.
RARITY = 1 << 18
_MULTIPLIERS = np.random.default_rng(6).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PARITIES = [f"s{i}" for i in range(8)]
_words = re.compile(WORD).findall


def shingle_hashes(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the k-word shingles in text order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        h = (h ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles made distinct: the n-th occurrence of a shingle is hashed with n, the first stays as it is."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    same = np.zeros(n, dtype=bool)
    same[1:] = h[order][1:] == h[order][:-1]
    if not same.any():
        return h
    place = np.arange(n)
    label = np.empty(n, dtype=np.uint64)
    label[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
    return np.where(label > 0, (h + label) * np.uint64(0xBF58476D1CE4E5B9), h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Signed 64-bit sketches of a document's labelled shingles, one a hash function."""
    out = np.empty(SKETCHES, dtype=np.uint64)
    m = min(TUPLE, len(shingles))
    block = max(1, (1 << 20) // len(shingles))
    for at in range(0, SKETCHES, block):
        mult = _MULTIPLIERS[at : at + block, None]
        value = shingles[None, :] * mult
        value ^= value >> np.uint64(29)
        value *= mult
        least = np.argpartition(value, m - 1, axis=1)[:, :m] if m < len(shingles) else np.tile(np.arange(m), (len(mult), 1))
        picked = shingles[np.sort(least, axis=1)]
        h = np.arange(at, at + len(mult), dtype=np.uint64) + np.uint64(1)
        for i in range(m):
            h = (h ^ picked[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[at : at + len(mult)] = h
    return out.view(np.int64)


def _subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence with places at most ``band`` apart, by a table whose rows are the bits of one number."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    window, row = (1 << 2 * band + 1) - 1, every
    for i, x in enumerate(a.tolist()):
        if x in where:
            inside = window << i - band if i >= band else window >> band - i
            hit = row & where[x] & inside
            row = (row + hit | row & ~hit) & every
    return len(b) - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Shingles that align in order within the band that ``threshold`` allows; 0 where it is plain that too few can."""
    least = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < least - 1e-9:
        return 0
    x, y = labelled(a), labelled(b)
    order = np.argsort(y)
    at = np.searchsorted(y, x, sorter=order)
    at[at == len(y)] = 0
    match = order[at]
    hit = np.flatnonzero(y[match] == x)
    if len(hit) < least - 1e-9:  # no more can align than are common
        return 0
    band = int(max(len(a), len(b)) - least + 1e-9)
    if x is not a or y is not b:
        return _subsequence(a, b, band)
    match = match[hit]
    match = match[np.abs(match - hit) <= band]
    if len(match) < least - 1e-9:
        return 0
    if not (np.diff(match) < 0).any():
        return len(match)
    tails: list[int] = []
    for p in match.tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Ordered similarity of two shingle sequences; exact where it reaches ``threshold``, smaller otherwise."""
    n = aligned(a, b, threshold)
    return n / (len(a) + len(b) - n) if len(a) + len(b) else 1.0


def sketches(rows: DataFrame) -> DataFrame:
    """row, id, sha, w1 and w2 (hash of the words), sketches, and short (up to SHORT shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found, short = [], [], []
            for text in b.column(3).to_pylist():
                words = _words(text)
                names.append(np.frombuffer(hashlib.sha256(" ".join(words).encode()).digest()[:16], dtype="<i8"))
                found.append(sketch(labelled(shingle_hashes(words))) if words else None)
                short.append(len(words) < SHORT + SHINGLE)
            own = [pa.array([int(x[i]) for x in names], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *own, pa.array(found, pa.list_(pa.int64())), pa.array(short)], ["row", "id", "sha", "w1", "w2", "sketches", "short"]
            )

    return arrow_map(rows.select("row", "id", "sha", "text"), run, "row long, id long, sha string, w1 long, w2 long, sketches array<long>, short boolean")


def meetings(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each bucket of two or more: id, low and high (first and last text of a bucket it is in), crowded (more than three are in it); and pairs of neighbours."""
    rows = texts.select("id", F.explode("sketches").alias("key"))
    ends = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    # Written, as adaptive execution splits a skewed join only where both sides come straight from a shuffle.
    ends = written(ends.filter("low < high"), "bucket-ends")
    met = written(rows.join(ends, "key").select("id", "low", "high", (F.col("n") > 3).alias("crowded")).distinct(), "meetings")
    crowds = rows.join(ends.filter("n > 3").select("key"), "key")
    return met, neighbours(crowds)


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of ids next to each other in a random order of their bucket, of (id, key); a bucket of any size is cut where ranges end."""
    order = F.xxhash64("id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 2), dtype=np.int64)
        for b in batches:
            both = np.concatenate([last, np.stack([b.column(i).to_numpy() for i in range(2)], axis=1)])
            same = (both[1:, 1] == both[:-1, 1]) & (both[1:, 0] != both[:-1, 0])
            x, y = both[:-1, 0][same], both[1:, 0][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            last = both[-1:]

    dealt = rows.select("id", "key").repartitionByRange("key", order).sortWithinPartitions("key", order)
    return arrow_map(dealt, run, "a long, b long").distinct()


def shingles_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles, and their parity bits s0 to s7, of the rows named in ``ids``; whole texts are shuffled here and nowhere else.

    ``ids`` grows with the rows, so it is merged and never broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(_words(text)) for text in b.column(1).to_pylist()]
            odd = [np.packbits(np.bincount((labelled(x) >> np.uint64(20)).astype(np.int64) % 512, minlength=512) & 1).view(np.int64) for x in found]
            columns = [pa.array(c) for c in np.array(odd, dtype=np.int64).reshape(-1, 8).T]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *columns], ["id", "shingles", *_PARITIES])

    texts = rows.select(F.col("row").alias("id"), "text").join(ids.hint("merge"), "id")
    return written(arrow_map(texts, run, "id long, shingles array<long>, " + ", ".join(f"{c} long" for c in _PARITIES)), "shingles")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends don't have one label (id, label)."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"l{end}")), end, "left")
    return pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _rarities(shingled: DataFrame) -> np.ndarray:
    """How many labelled shingles fall into each of RARITY slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, dtype=np.int64)
        for b in batches:
            own = [labelled(np.asarray(x.values, dtype=np.int64).view(np.uint64)) for x in b.column(1)]
            counts += np.bincount((np.concatenate(own) % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    rows = arrow_map(shingled, run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(RARITY, dtype=np.int64)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _rarest(shingled: DataFrame, threshold: float) -> DataFrame:
    """id, label, n (shingles of the text), key (a shingle of its prefix), most (shingles of the longest text it can meet there), earlier (up to EARLIER rarer shingles)."""
    counts = shingled.sparkSession.sparkContext.broadcast(_rarities(shingled.select("id", "shingles")))
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, sizes, keys, most, earlier = [], [], [], [], [], []
            for i, label, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = labelled(np.asarray(found.values, dtype=np.int64).view(np.uint64)).view(np.int64)
                n = len(own)
                if not n:
                    continue
                order = np.lexsort((own, counts.value[(own.view(np.uint64) % np.uint64(RARITY)).astype(np.int64)]))
                left = n - np.arange(min(n, int((1 - threshold) * n + 1e-9) + 1))
                ids.append(np.full(len(left), i, dtype=np.int64))
                labels.append(np.full(len(left), label, dtype=np.int64))
                sizes.append(np.full(len(left), n, dtype=np.int64))
                keys.append(own[order[: len(left)]])
                most.append(np.floor(left / share - n + 1e-6).astype(np.int64))
                earlier += [keys[-1][: min(i, EARLIER)] for i in range(len(left))]
            if ids:
                columns = [pa.array(np.concatenate(c)) for c in (ids, labels, sizes, keys, most)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(earlier, pa.list_(pa.int64()))], ["id", "label", "n", "key", "most", "earlier"])

    return arrow_map(shingled.select("id", "label", "shingles"), run, "id long, label long, n long, key long, most long, earlier array<long>")


def exact_candidates(texts: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair of ``texts`` that can reach the threshold and whose ends don't have one label (id, label).

    Two such texts share a labelled shingle among the rarest of both, at places i and j of n and m, with
    min(n - i, m - j) >= threshold / (1 + threshold) * (n + m). At most one of the two can lie behind the
    place where texts of equal length still meet, so one side of the join is always ahead of it; and as
    the label with most rows of a shingle doesn't meet itself, one side always has another label. Parity bits of
    two texts differ in no more places than the texts have shingles apart, so too many drop a pair safely. A pair
    that has met at a rarer shingle, as far as the rows tell, is not made again.
    """
    named = texts.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "shingles")
    rows = written(_rarest(named, threshold).withColumn("ahead", F.col("most") >= F.col("n")), "rarest")
    counted = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), F.max("ahead").alias("ahead"))
    mixed = counted.groupBy("key").agg(F.max(F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.max("ahead").alias("any"))
    mixed = written(mixed.filter("labels > 1 AND any").select("key", F.col("top.label").alias("major")), "mixed-shingles")
    rows = rows.join(mixed, "key").withColumn("minor", F.col("label") != F.col("major")).drop("major")
    rows = written(rows.join(texts.drop("shingles"), "id"), "mixed-rows")
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in rows.columns if c != "key"])
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}2"))) for i in range(8)), F.lit(0))
    alike = (F.col("n") + F.col("n2")) * (1 - 2 * threshold / (1 + threshold)) + 1e-6 >= differ
    met = F.arrays_overlap("earlier", "earlier2")
    fits = alike & ~met & (F.col("label") != F.col("label2")) & (F.col("n2") <= F.col("most")) & (F.col("n") <= F.col("most2"))
    ends = F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")
    found = []
    for left, right in ((rows.filter("minor AND ahead"), other), (rows.filter("minor AND NOT ahead"), other.filter("NOT minor2 AND ahead2"))):
        found.append(left.join(right, "key").filter(fits).select(*ends))
    return written(found[0].unionByName(found[1]).distinct(), "exact-pairs")


def links(shingled: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose alignment reaches the threshold."""
    sides = [shingled.select(F.col("id").alias(end), F.col("shingles").alias(f"s_{end}")) for end in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.asarray(v.values, dtype=np.int64).view(np.uint64) for v in batch.column(i)] for i in (2, 3))
            good = pa.array([similarity(u, v, threshold) >= threshold - 1e-12 for u, v in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return written(arrow_map(both, run, "a long, b long").distinct(), "links")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id and label (least id of its component) of every id in ``edges`` (a, b).

    Each round every id moves to its least neighbour, from there to that one's, and so on for eight steps in
    three doublings. Then the edges are contracted: ends take their new ids, and edges within one id go. The least id of a component never moves, so it is what
    is left. After a number of ``rounds`` labels may differ within a component, but equal ones never join
    two. Every round is a written table; the driver learns whether edges are left.
    """
    rest, labels = written(edges.select("a", "b"), "edges"), None
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("to")), "steps")
        for _ in range(3):
            step = written(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("top")), "to").select("id", F.col("top").alias("to")), "steps")
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            moved = labels.join(step.withColumnRenamed("id", "label"), "label", "left")
            labels = written(moved.select("id", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            rest = rest.join(step.select(F.col("id").alias(end), F.col("to").alias(f"to_{end}")), end)
        ends = F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
        rest = written(rest.filter("to_a <> to_b").select(*ends).distinct(), "edges")
        rounds = rounds and rounds - 1
        if rounds == 0 or rest.isEmpty():
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row, id, sha (of :func:`identified`) and class (least row of its group) of every row of ``docs``."""
    source = identified(docs)
    rows = written(sketches(source), "sketches")
    if not rows.filter("sha IS NOT NULL").isEmpty():
        source = source.dropDuplicates(["row"])
    same = written(rows.groupBy("w1", "w2").agg(F.min("row").alias("id")), "texts")
    own = rows.filter("sketches IS NOT NULL").select("w1", "w2", "row", "sketches", "short").join(same, ["w1", "w2"]).filter("row = id")
    texts = written(own.select("id", "sketches", "short").dropDuplicates(["id"]), "distinct-texts")
    met, near = meetings(texts)
    low = written(met.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    high = met.filter("id <> low AND id <> high").select(F.col("id").alias("a"), F.col("high").alias("b")).distinct()
    doubtful = written(met.filter("crowded").select("id").unionByName(texts.filter("short").select("id")).distinct(), "doubtful")
    shingled = shingles_of(source, met.select("id").unionByName(doubtful).distinct())

    found = links(shingled, low, threshold)
    more = apart(high.unionByName(near).distinct(), components(found, rounds=1))
    found = found.unionByName(links(shingled, written(more, "pairs"), threshold))
    labels = components(found)
    exact = links(shingled, exact_candidates(shingled.join(doubtful, "id"), labels, threshold), threshold)
    if not exact.isEmpty():
        labels = components(found.unionByName(exact))
    named = same.join(labels, "id", "left").select("w1", "w2", F.coalesce("label", "id").alias("class"))
    return written(rows.select("row", "id", "sha", "w1", "w2").join(written(named, "classes"), ["w1", "w2"]).drop("w1", "w2"), "members")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id (least id of its group), class_size, kept (the row names the group; so do rows that repeat it)."""
    members = classes(docs, threshold)
    sizes = written(members.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min("id").alias("class_id")), "sizes")
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    kept = (F.col("row") == F.col("class")).alias("kept")
    return members.join(sizes, "class").select(plain("id").alias("doc_id"), plain("class_id").alias("class_id"), "class_size", kept)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` a group, with all its columns: the one that names the group."""
    return keep_rows(docs, classes(docs, threshold).filter("row = class"))
