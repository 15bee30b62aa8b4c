"""Removal of repeated substrings with suffix arrays built by two-stage sorting.

Every byte that lies in a LENGTH-byte string which also starts earlier is removed. Earlier means a
smaller doc_id, or the same document and a smaller offset; overlaps count, matches never cross
documents, and strings are judged on the input.

A suffix array of a whole corpus has a place for each byte, far too much to shuffle. So windows meet
by content first, and suffixes are sorted where windows can differ:

1. Segments. Of the k-grams in a window the one with the least hash is its anchor. Consecutive
   windows with one anchor form a segment; equal windows have equal anchors at equal offsets, so
   equal windows always lie in segments of one anchor. There is a segment for about 40 bytes.
2. First segments. Tasks send one entry for each distinct segment to the owner of its anchor's range,
   and owners keep the smallest place. Of equal segments only the first can hold a first window, so
   every other is a mark: its windows are repeated. Copies collapse in the task before they travel.
3. Suffix arrays. Anchors with several distinct segments ask the documents for these segments' bytes.
   Owners concatenate the bytes, sort all suffixes to depth LENGTH in two stages and scan adjacent common
   prefixes: neighbours that share LENGTH bytes are equal windows, and all but the first are marks.
   Anchors with more than HOT distinct segments are spread by window: each window then goes to the
   owner of its own hash. Both ways are exact.
4. The marks of each document are joined with its text.

Owners are buckets of bounded size; a task sorts its rows by bucket, on disk if need be, and holds one at a time. Nothing of the
texts reaches the driver but their total size and the number of segments to sort.

Null text counts as empty. A null doc_id comes before all others. Rows that repeat an id
and its text are one place: neither loses a string to the other's equal offset. Rows of one id, or of
none, with different texts are documents of their own, ordered by id and then by a hash of the text. Texts of any length are taken whole, in chunks.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, arrow_map, identified, written

LENGTH = 100
#: Bytes of an anchor's k-gram.
GRAM = 20
#: Distinct segments of an anchor beyond which its windows are spread one by one.
HOT = 2048
#: Text bytes that a bucket gets anchors of, and segment bytes that a suffix array is built of.
OWNED, SORTED = 8 << 20, 128 << 10
#: Buckets that an owner task and a sorting task take one after the other, and the number of tasks from which on each takes more.
OWNER_FINE, FINE, MOST_TASKS = 4, 16, 1 << 16
#: Segments that a task holds before it keeps the first of each kind.
HELD = 1 << 20
#: A text is cut this many window starts at a time; short texts are cut together, up to so many bytes.
CHUNK, GROUP = 2 << 20, 64 << 10

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash multiplier and of its inverse, as far as any text needed them."""

    def __init__(self):
        self.n, inverse = 0, pow(int(_M1), -1, 1 << 64)
        self.inverse = np.uint64(inverse)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            ones = np.ones(self.n, dtype=np.uint64)
            ones[1:] = _M1
            self.up = np.cumprod(ones)
            ones[1:] = self.inverse
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _cut(raw: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand one behind the other in ``raw``: text number, first window, windows, anchor hash, segment hash."""
    n, w = len(raw), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = _POWERS.get(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=prefix[1:])
    value = _mix((prefix[gram:] - prefix[:-gram]) * up[: n - gram + 1])
    place = np.uint64((1 << 24) - 1)
    least = (value & ~place) | np.arange(len(value), dtype=np.uint64)
    step = 1
    while 2 * step <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < w:
        least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
    anchor = (least & place).astype(np.int64)
    ends = np.cumsum(sizes)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[ends - sizes] = True  # a text begins
    fresh = fresh[: len(anchor)]
    fresh[1:] |= anchor[1:] != anchor[:-1]
    fresh[0] = True
    starts = np.flatnonzero(fresh)
    stops = np.concatenate([starts[1:], [len(anchor)]])
    text = np.searchsorted(ends, starts, side="right")
    counts = np.minimum(stops, ends[text] - length + 1) - starts  # windows don't reach over the end of their text
    ok = counts > 0
    starts, counts, text = starts[ok], counts[ok], text[ok]
    whole = (prefix[starts + counts + length - 1] - prefix[starts]) * up[starts]
    # Anchors have the least hashes around, so these are mixed again to spread evenly over ranges.
    return text, starts - (ends - sizes)[text], counts, _mix(value[anchor[starts]] + _M1), _mix(whole ^ _mix(counts.astype(np.uint64)))


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts: text number, first window, number of windows, anchor hash, hash of the segment's bytes.

    Short texts are cut together, long ones a chunk of windows at a time; where a chunk ends matters to no result.
    """
    parts, group, size = [], [], 0

    def cut(texts: list[bytes], first: int, at: int = 0) -> None:
        number, start, *rest = _cut(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts]), length, gram)
        parts.append((number + first, start + at, *rest))

    for i, t in enumerate(texts):
        if group and size + len(t) > GROUP:
            cut(group, i - len(group))
            group, size = [], 0
        if len(t) <= CHUNK:
            group.append(t)
            size += len(t)
            continue
        for at in range(0, len(t) - length + 1, CHUNK):
            cut([t[at : at + CHUNK + length - 1]], i, at)
    if group:
        cut(group, len(texts) - len(group))
    if not parts:
        return _cut(np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), length, gram)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple]:
    """Texts of a batch, and of their segments: text number, doc_id, first window, windows, anchor hash, segment hash."""
    for b in batches:
        texts = b.column(1).to_pylist()
        ids = np.array([NO_ID if d is None else d for d in b.column(0).to_pylist()], dtype=np.int64)
        number, *rest = segments(texts, length, gram)
        yield texts, number, ids[number], *rest


def _parts(order_key: np.ndarray, owners: int) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array of hashes by the owner of their range; owners is a power of two."""
    if not len(order_key):
        return
    owner = (order_key >> np.uint64(65 - owners.bit_length())).astype(np.int64) if owners > 1 else np.zeros(len(order_key), dtype=np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(owner[low]), slice(int(low), int(high))




#: A segment as tasks hold it, and what of it travels to a bucket; bits of the anchor's hash beyond these 32 and the bucket's only save work.
_ENTRY = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("n", "<i8")])
_SENT = {"key": "<u4", "hash": "<u8", "doc": "<i8", "at": "<u4", "n": "<u2"}
#: Entries or marks of a row that travels.
PACKED = 1 << 15


def _pack(e: np.ndarray, owners: int) -> list[bytes]:
    """The columns of entries of one bucket."""
    key = (e["key"] << np.uint64(owners.bit_length() - 1)) >> np.uint64(32)
    return [(key if c == "key" else e[c]).astype(kind).tobytes() for c, kind in _SENT.items()]


def _unpack(columns: list[list[bytes]], bucket: int, owners: int) -> np.ndarray:
    """Entries that came to a bucket."""
    e = np.empty(sum(map(len, columns[1])) // 8, dtype=_ENTRY)
    for (c, kind), parts in zip(_SENT.items(), columns, strict=True):
        e[c] = np.frombuffer(b"".join(parts), dtype=kind)
    bits = owners.bit_length() - 1
    e["key"] = (e["key"] << np.uint64(32)) >> np.uint64(bits)
    if bits:
        e["key"] |= np.uint64(bucket) << np.uint64(64 - bits)
    return e


def _firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest place of each distinct segment, in order of anchor, and the entries of other places."""
    e = e[np.lexsort((e["at"], e["doc"], e["hash"], e["key"]))]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["hash"][1:] != e["hash"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (e["doc"] == e["doc"][head]) & (e["at"] == e["at"][head])  # a repeated row's segment is at the first place too
    return e[new], e[~same]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by bucket, the first column, one bucket at a time."""
    now, held = None, []
    for b in batches:
        buckets = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            if held and buckets[low] != now:
                yield now, held
                held = []
            now = int(buckets[low])
            held.append(b.slice(low, high - low))
    if held:
        yield now, held


def _dealt(rows: DataFrame, buckets: int, fine: int) -> DataFrame:
    """Rows by bucket, a power of two, with neighbouring buckets in one task and sorted there."""
    tasks = min(max(1, buckets // fine), MOST_TASKS)
    return rows.repartitionById(tasks, F.expr(f"bucket div {buckets // tasks}").cast("int")).sortWithinPartitions("bucket")


# --- two-stage suffix sorting -------------------------------------------------------------------


def words_of(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)]).astype(np.uint64)
    n = len(text) + depth + 8
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + n]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the one behind it; the last is not."""
    n = len(text)
    differ = np.flatnonzero(text[1:] != text[:-1])
    up = np.concatenate([text[differ] < text[differ + 1], [False]])
    return up[np.searchsorted(differ, np.arange(n))]


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes; ties are refined word by word."""
    if not len(at):
        return at
    order = at[np.argsort(words[at], kind="stable")]
    value = words[order]
    group = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    for skip in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        value = words[order[tied] + skip]
        moved = np.lexsort((value, group[tied]))
        order[tied] = order[tied][moved]
        value, own = value[moved], group[tied]
        fresh = np.zeros(len(order), dtype=np.int64)
        fresh[tied[1:]] = (value[1:] != value[:-1]) & (own[1:] == own[:-1])
        new = np.concatenate([[False], group[1:] != group[:-1]]) | (fresh == 1)
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    With ``wanted``, the array has these positions and those from which they are induced, else all.

    Suffixes smaller than their successors are sorted directly. The others are induced by one scan over
    the buckets of first bytes, from low to high: when a bucket is complete, the predecessors of its
    suffixes, in order, are the next of their own buckets, as each is larger than its successor. Runs of
    one byte feed the bucket itself, shorter runs first.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    words = words_of(text, depth) if words is None else words
    small = smaller_than_successor(text)
    active = np.ones(n, dtype=bool) if wanted is None else wanted.copy()
    new = np.flatnonzero(active & ~small)
    while wanted is not None and len(new):
        new = new[new < n - 1] + 1
        new = new[~active[new]]
        active[new] = True
        new = new[~small[new]]
    direct = _sort_directly(np.flatnonzero(small & active), words, depth)
    larger = active & ~small
    edge = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[-1]:
        waiting[text[-1]].append(np.array([n - 1]))  # the empty suffix behind it comes before all
    out = []

    def induce(done: np.ndarray, byte: int) -> np.ndarray:
        """Hands predecessors to their buckets; returns those of this bucket."""
        before = done[done > 0] - 1
        before = before[larger[before]]
        first = text[before]
        later = before[first > byte]
        by = text[later]
        order = np.argsort(by, kind="stable")
        later, by = later[order], by[order]
        cuts = np.concatenate([[0], np.flatnonzero(by[1:] != by[:-1]) + 1, [len(by)]]) if len(by) else np.zeros(1, dtype=np.int64)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            waiting[by[low]].append(later[low:high])
        return before[first == byte]

    for byte in range(256):
        part = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        while len(part):
            out.append(part)
            part = induce(part, byte)
        part = direct[edge[byte] : edge[byte + 1]]
        if len(part):
            out.append(part)
            induce(part, byte)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, up to ``depth``; 0 for the first."""
    shared = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for skip in range(0, depth, 8):
        differ = words[order[open_] + skip] ^ words[order[open_ - 1] + skip]
        equal = differ == 0
        shared[open_[equal]] += 8
        rest, bits = open_[~equal], differ[~equal]
        for i in range(7):
            same = bits >> np.uint64(56 - 8 * i) == 0
            shared[rest[same]] += 1
            rest, bits = rest[same], bits[same]
        open_ = open_[equal]
    return np.minimum(shared, depth)


def repeated_windows(text: np.ndarray, doc: np.ndarray, at: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions whose window of ``length`` bytes equals one at an earlier place.

    ``doc`` and ``at`` give each position's place; only ``valid`` positions start a window.
    """
    words = words_of(text, length)
    order = suffix_array(text, length, words, valid)
    shared = common_prefixes(order, words, length)
    group = np.cumsum(shared < length)
    ok = valid[order]
    order, group = order[ok], group[ok]
    ranked = np.lexsort((at[order], doc[order], group))
    order, group = order[ranked], group[ranked]
    # equal places are one place: repeated rows don't remove each other
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else np.zeros(0, dtype=np.int64)
    same = (doc[order] == doc[order[head]]) & (at[order] == at[order[head]])
    return np.sort(order[~same])


# --- the distributed steps ----------------------------------------------------------------------


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def _mark_rows(doc: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray | None = None, kind: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    zeros = np.zeros(len(doc), dtype=np.int64)
    columns = {"doc_id": doc, "at": at, "n": n, "key": zeros if key is None else key, "kind": zeros if kind is None else kind}
    for low in range(0, len(doc), PACKED):
        yield pa.RecordBatch.from_pydict({c: np.ascontiguousarray(x[low : low + PACKED]).astype(np.int64) for c, x in columns.items()})


def marks(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Marks of documents: in document ``doc_id`` the ``n`` windows from ``at`` on are repeated.

    ``rows`` has doc_id, not null, and the text as binary.
    """
    if length - gram >= 1 << 16:
        raise ValueError("an anchor may lie at most 65535 bytes behind its window's start")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    owners = _power_of_two(total / OWNED)

    def send_segments(batches):
        """Distinct segments of a task by bucket; those at later places are marks already."""
        held, size, limit = [], 0, HELD

        def sent(bucket, columns, gone=None):
            values = [*(columns or [None] * len(_SENT)), gone]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["bucket", *_SENT, "gone"])

        def reduced():
            e, later = _firsts(np.concatenate(held) if held else np.zeros(0, dtype=_ENTRY))
            runs = np.stack(_runs(later["doc"], later["at"], later["n"]), axis=1)
            return [e], [sent(int(abs(part[0, 0])) % owners, None, part.tobytes()) for part in (runs[low : low + PACKED] for low in range(0, len(runs), PACKED))]

        for _, _, doc, at, n, key, whole in _cut_batches(batches, length, gram):
            e = np.empty(len(key), dtype=_ENTRY)
            e["key"], e["hash"], e["doc"], e["at"], e["n"] = key, whole, doc, at, n
            held.append(e)
            size += len(e)
            if size > limit:  # reduced on the way, so that a task holds distinct segments and no more
                held, gone = reduced()
                yield from gone
                size = len(held[0])
                limit = max(HELD, 2 * size)
        held, gone = reduced()
        yield from gone
        for bucket, s in _parts(held[0]["key"], owners):
            part = held[0][s]
            for low in range(0, len(part), PACKED):
                yield sent(bucket, _pack(part[low : low + PACKED], owners))

    def own_segments(batches):
        """Marks (kind 0), and segments whose bytes are to be sorted as a whole (kind 1) or window by window (kind 2)."""
        for bucket, parts in _by_bucket(batches):
            columns = [[v for p in parts for v in p.column(i).to_pylist() if v is not None] for i in range(1, len(_SENT) + 2)]
            for gone in columns.pop():
                yield from _mark_rows(*np.frombuffer(gone, dtype=np.int64).reshape(-1, 3).T)
            e, later = _firsts(_unpack(columns, bucket, owners))
            yield from _mark_rows(later["doc"], later["at"], later["n"])
            _, number, n = np.unique(e["key"], return_inverse=True, return_counts=True)
            kind = np.where(n > hot, 2, 1)[number]
            e, kind = e[n[number] > 1], kind[n[number] > 1]
            yield from _mark_rows(e["doc"], e["at"], e["n"], e["key"].astype(np.int64), kind)

    schema = ", ".join(["bucket int", *(f"{c} binary" for c in _SENT), "gone binary"])
    sent = _dealt(arrow_map(rows, send_segments, schema), owners, OWNER_FINE)
    owned = written(arrow_map(sent, own_segments, "doc_id long, at long, n long, key long, kind long"), "segments")
    wanted = owned.filter("kind > 0")
    sorters = _power_of_two(2 * wanted.count() * (length + 40) / SORTED)
    asked = wanted.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("at", "n", "key", "kind")).alias("asked"))
    asked = asked.select("id", *(F.col(f"asked.{c}").alias(c) for c in ("at", "n", "key", "kind")))
    asked = rows.join(asked, F.col("doc_id") == F.col("id")).select("doc_id", "text", "at", "n", "key", "kind")

    def send_bytes(batches):
        """Segments as a whole, or each window of them, with their smallest place in the task; a later window becomes a mark at once."""
        held, later, size = {}, [], 0
        shift = 65 - sorters.bit_length()
        for b in batches:
            for doc, text, *lists in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for start, count, key, kind in zip(*lists, strict=True):
                    single = kind == 2
                    for s in range(start, start + count) if single else (start,):
                        piece = text[s : s + (length if single else count + length - 1)]
                        h = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big") if single else key & (1 << 64) - 1
                        where = h >> shift if sorters > 1 else 0
                        place = held.get((where, piece))
                        if place is None:
                            size += len(piece)
                        elif single and place != (doc, s):
                            later.append(max(place, (doc, s)))
                        if place is None or (doc, s) < place:
                            held[where, piece] = (doc, s)
                if size + 16 * len(later) > 16 << 20:
                    yield from _segment_rows(held, later, sorters)
                    held, later, size = {}, [], 0
        yield from _segment_rows(held, later, sorters)

    def sort(batches):
        """A suffix array for each bucket."""
        for _, parts in _by_bucket(batches):
            held: dict[bytes, tuple[int, int]] = {}
            for b in parts:
                known = b.filter(pc.greater(b.column(3), 0))
                if known.num_rows:
                    yield known.select(["doc_id", "at", "n"])
                later = []
                for _, doc, at, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if n:
                        continue
                    place = held.get(text)
                    if place is not None and place != (doc, at):
                        later.append((*max(place, (doc, at)), len(text) - length + 1))
                    if place is None or (doc, at) < place:
                        held[text] = (doc, at)
                if later:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(later, dtype=np.int64).T], ["doc_id", "at", "n"])
            if not held:
                continue
            sizes = np.array([len(t) for t in held])
            text = np.frombuffer(b"".join(held), dtype=np.uint8)
            inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            places = np.array(list(held.values()), dtype=np.int64)
            doc, at = np.repeat(places[:, 0], sizes), np.repeat(places[:, 1], sizes) + inside
            found = repeated_windows(text, doc, at, inside + length <= np.repeat(sizes, sizes), length)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(doc[found], at[found])], ["doc_id", "at", "n"])

    dealt = _dealt(arrow_map(asked, send_bytes, "bucket int, doc_id long, at long, n long, text binary"), sorters, FINE)
    again = written(arrow_map(dealt, sort, "doc_id long, at long, n long"), "repeated-windows")
    return owned.filter("kind = 0").select("doc_id", "at", "n").unionByName(again)


def _runs(doc: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, of ``n`` windows or of one, as runs: document, first window, number of windows."""
    n = np.ones(len(at), dtype=np.int64) if n is None else n
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    if not len(at):
        return doc, at, n
    # places of one document that repeat come from repeated rows and have the same windows
    head = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] > (at + n)[:-1])) + 1])
    last = np.concatenate([head[1:], [len(at)]]) - 1
    return doc[head], at[head], at[last] + n[last] - at[head]


def _segment_rows(held: dict, later: list, sorters: int) -> Iterator[pa.RecordBatch]:
    """Rows with bytes have n = 0; rows without are marks."""
    names = ["bucket", "doc_id", "at", "n", "text"]
    if later:
        doc, at, n = _runs(*np.array(later, dtype=np.int64).T)
        for low in range(0, len(doc), 8192):
            d, a, m = doc[low : low + 8192], at[low : low + 8192], n[low : low + 8192]
            yield pa.RecordBatch.from_arrays([pa.array((d % sorters).astype(np.int32)), pa.array(d), pa.array(a), pa.array(m), pa.nulls(len(d), pa.binary())], names)
    items = list(held.items())
    for low in range(0, len(items), 8192):
        part = items[low : low + 8192]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w for (w, _), _ in part], pa.int32()), pa.array([d for _, (d, _) in part], pa.int64()),
                pa.array([s for _, (_, s) in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([t for (_, t), _ in part], pa.binary()),
            ],
            names,
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the bytes that stay)."""
    rows = identified(docs).select("row", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = marks(rows.select(F.col("row").alias("doc_id"), "text"), length, gram, hot)
    listed = found.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    joined = rows.join(listed, "row", "left").select("doc_id", "text", F.col("marks.at").alias("ats"), F.col("marks.n").alias("ns"))

    def run(batches):
        for b in batches:
            rows = []
            ids, texts = b.column(0), b.column(1).to_pylist()
            for text, ats, ns in zip(texts, b.column(2), b.column(3), strict=True):
                raw = np.frombuffer(text, dtype=np.uint8)
                first, n = (np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64) for x in (ats, ns))
                edge = np.bincount(first, minlength=len(raw) + 1) - np.bincount(first + n + length - 1, minlength=len(raw) + 1)
                cover = np.cumsum(edge[:-1]) > 0
                stay = raw[~cover].tobytes()
                spans = int(np.count_nonzero(cover[1:] & ~cover[:-1])) + int(bool(len(cover) and cover[0]))
                rows.append((len(raw), len(raw) - len(stay), spans, hashlib.sha256(stay).hexdigest(), stay))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([ids, *columns][: 6 if keep_text else 5], names[: 6 if keep_text else 5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return arrow_map(joined, run, schema)
