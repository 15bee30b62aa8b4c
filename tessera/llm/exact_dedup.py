"""Exact deduplication by an extendible-hash index on shared files.

1. Every text is normalised (A-Z lower-cased) and fingerprinted: a 64-bit key, its SHA-256
   and its length. These entries, without texts, are one small written table.
2. A directory is built from a histogram of the bytes behind each key prefix. Doubling starts
   from one bucket: an overfull bucket splits by its next key bit, and the directory doubles
   when a bucket as deep as the directory must split. Buckets are key ranges.
3. Owner tasks process key ranges: as many neighbouring buckets as have OWNED bytes together. Map tasks first collapse
   equal texts, so a group of copies reaches its owner as at most a few rows a map task. An owner gets its
   rows in the order of bucket and key, chains entries of equal key, compares bytes, and writes the index to the shared
   folder. It holds the chain of one key at a time, so a bucket's size bounds no memory: where the directory is as
   large as it may be (2**MAX_DEPTH cells, 4 TB of distinct text), buckets grow and nothing else changes.
4. Entries look their group up by key. Where a key's chain has several links, the digest tells which;
   where it has one, the owner's comparison of bytes has shown that all texts of the key are equal.
   Skewed groups are split by adaptive joins.

Null text counts as empty, empty texts equal each other. Texts of any length are taken whole. Rows that repeat both text and id
count as copies; exactly one row of a group is kept. A null id is smaller than any other.
Other columns are ignored, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, arrow_map, keep_rows, text_or_empty, written

#: Bytes of distinct text in a bucket; a larger one splits.
CAPACITY = 4 << 20
#: Bytes of distinct text that an owner task gets buckets of.
OWNED = 64 << 20
#: The directory has at most 2**MAX_DEPTH cells.
MAX_DEPTH = 20
#: Bytes of distinct text that a map task collapses before it passes them on.
COLLAPSE = 24 << 20


def key_of(normalised: bytes, bits: int = 64) -> int:
    """Signed 64-bit hash key; fewer ``bits`` force collisions, for tests."""
    k = xxhash.xxh64_intdigest(normalised) >> (64 - bits) << (64 - bits)
    return k - (1 << 64) if k >> 63 else k


def directory(cells: dict[int, int], depth: int, capacity: int) -> np.ndarray:
    """Bucket number of each of the 2**depth key prefixes; buckets are numbered by key range.

    ``cells`` has the bytes behind each prefix. Splitting stops at ``depth`` bits.
    """
    size = np.zeros(1 << depth, dtype=np.int64)
    for prefix, n in cells.items():
        size[prefix] += n
    total = np.concatenate([[0], np.cumsum(size)])
    pointers, global_depth, local = np.zeros(1, dtype=np.int64), 0, {0: (0, 0)}  # bucket: (local depth, prefix)
    overfull = [0]
    while overfull:
        bucket = overfull.pop()
        d, prefix = local[bucket]
        low, high = prefix << (depth - d), (prefix + 1) << (depth - d)
        if d == depth or total[high] - total[low] <= capacity:
            continue
        if d == global_depth:
            pointers, global_depth = np.repeat(pointers, 2), global_depth + 1
        new = len(local)
        local[bucket], local[new] = (d + 1, 2 * prefix), (d + 1, 2 * prefix + 1)
        step = global_depth - d - 1
        pointers[(2 * prefix + 1) << step : (2 * prefix + 2) << step] = new
        overfull += [bucket, new]
    wide = np.repeat(pointers, 1 << (depth - global_depth))
    return np.concatenate([[0], np.cumsum(np.diff(wide) != 0)]).astype(np.int32)


def entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, key, text_sha256 and n_bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [t.lower() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([key_of(t, key_bits) for t in low], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in low], pa.string()),
                    pa.array([len(t) for t in low], pa.int64()),
                ],
                ["doc_id", "key", "text_sha256", "n_bytes"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().cast("binary")), run, "doc_id long, key long, text_sha256 string, n_bytes long")


def build_directory(fingerprints: DataFrame, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Directory over the distinct keys of the entries, the owner of each bucket, and the directory's depth; the driver sees 2**depth numbers at most."""
    keys = fingerprints.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    total = fingerprints.agg(F.sum("n_bytes").alias("n")).first().n or 0
    depth = int(np.clip(np.ceil(np.log2(max(1, total / capacity))) + 2, 1, MAX_DEPTH))
    cell = F.shiftrightunsigned("key", 64 - depth).alias("cell")
    cells = {r.cell: r.n for r in keys.groupBy(cell).agg(F.sum("n_bytes").alias("n")).collect()}
    pointers = directory(cells, depth, capacity)
    sizes = np.zeros(int(pointers[-1]) + 1, dtype=np.int64)
    for c, n in cells.items():
        sizes[pointers[c]] += n
    tasks = min(len(sizes), max(int(sizes.sum() / OWNED) + 1, fingerprints.sparkSession.sparkContext.defaultParallelism))
    before = np.cumsum(sizes) - sizes
    return pointers, np.minimum(before * tasks // max(1, int(sizes.sum())), tasks - 1).astype(np.int32), depth


_POSTING = "owner int, bucket int, key long, text binary, keep_id long, n long"
_INDEX = "bucket int, key long, chain int, chained int, text_sha256 string, keep_id long, group_size long"
_NAMES = ["owner", "bucket", "key", "text", "keep_id", "n"]


def _postings(pointers: np.ndarray, owners: np.ndarray, depth: int, key_bits: int):
    """Map side: equal texts of a task become one row with their largest id and count."""

    def emit(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        texts = list(held)
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            keys = [key_of(t, key_bits) for t in part]
            buckets = pointers[[(k & ((1 << 64) - 1)) >> (64 - depth) for k in keys]]
            ids, counts = (pa.array([held[t][i] for t in part], pa.int64()) for i in range(2))
            columns = [pa.array(owners[buckets], pa.int32()), pa.array(buckets, pa.int32()), pa.array(keys, pa.int64()), pa.array(part, pa.binary()), ids, counts]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text.lower()
                if (entry := held.get(text)) is None:
                    held[text] = [doc_id, 1]
                    size += len(text)
                else:
                    entry[1] += 1
                    if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                        entry[0] = doc_id
            if size > COLLAPSE:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of key ranges, in the order of bucket and key: chains of equal key, one link a distinct text; bytes decide."""
    done: list[tuple] = []
    place, chain = None, []  # links of the key at hand: text, largest id, rows

    def close() -> None:
        done.extend((*place, i, len(chain), hashlib.sha256(link[0]).hexdigest(), *link[1:]) for i, link in enumerate(chain))

    def emit() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "chain", "chained", "text_sha256", "keep_id", "group_size"])

    for b in batches:
        for bucket, key, text, doc_id, n in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
            if (bucket, key) != place:
                if chain:
                    close()
                place, chain = (bucket, key), []
            link = next((x for x in chain if x[0] == text), None)
            if link is None:
                chain.append([text, doc_id, n])
                continue
            link[2] += n
            if doc_id is not None and (link[1] is None or doc_id > link[1]):
                link[1] = doc_id
        if len(done) > 4096:
            yield emit()
            done.clear()
    if chain:
        close()
    yield emit()


def build_index(docs: DataFrame, pointers: np.ndarray, owners: np.ndarray, depth: int, key_bits: int = 64) -> DataFrame:
    """The index as a table in the shared folder: bucket, key, chain (number of the link), chained (links of the key), text_sha256, keep_id, group_size."""
    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().cast("binary"))
    rows = arrow_map(texts, _postings(pointers, owners, depth, key_bits), _POSTING)
    dealt = rows.repartitionById(int(owners[-1]) + 1, F.col("owner")).sortWithinPartitions("bucket", "key")
    return written(arrow_map(dealt, _own, _INDEX), "hash-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(entries(docs, key_bits), "hash-entries")
    index = build_index(docs, *build_directory(found, capacity), key_bits).select("key", "chained", "text_sha256", "keep_id", "group_size")
    # Only a repeated row shares both text and id with another; one of them stays. The number comes
    # before the join, which adaptive execution can then split where a group is large.
    twin = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("key"))
    found = found.withColumn("twin", twin).withColumnRenamed("text_sha256", "own_sha256")
    joined = found.join(index, "key").filter("chained = 1 OR own_sha256 = text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("twin") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows go by id. Where an id has several rows, they also go by text, and of rows with
    the same id and text one is taken.
    """
    kept = exact_dedup(docs, capacity).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_sha256").alias("sha"))
    return keep_rows(docs, kept, F.sha2(F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
