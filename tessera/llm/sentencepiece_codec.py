"""SentencePiece encoding with byte spans, and decoding.

Normalisation takes the longest prefix that the model's compiled character map knows, or else one
character, and records for every normalised byte where its source begins. A model without a map, as the production
one, has no known prefixes, so every character stands for itself. The normalised text is what is encoded, by the model's
pieces with its normaliser taken out; pieces partition it, so their byte lengths project each piece onto a span
of original UTF-8 bytes.

Where no piece of the model crosses from a sign to a word mark behind it (checked on loading), a normalised text
falls into units, each a run of word marks and what follows; the merges of a unit depend on it alone.
Distinct units are encoded by the sentencepiece library once and remembered up to a bound. Otherwise a
normalised text is one unit, and a task holds the pieces of one batch's whole texts.

Null text counts as empty and has begin and end id alone. Very long texts and units are taken
whole. Where pieces don't add up to the normalised text, spans are null and ids as they are. Repeated rows get a row each; columns besides
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, text_or_empty

MARK = "▁"
#: Remembered units in a task, and the longest that is remembered.
REMEMBERED, LONGEST = 200_000, 48


class CharacterMap:
    """The compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of ``text[start:]``."""
        units, found = self.units, None
        at = self._offset(units[0])
        for i in range(start, len(text)):
            at ^= text[i]
            unit = units[at]
            if unit & 0x800000FF != text[i]:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (units[at] & 0x7FFFFFFF, i + 1 - start)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[0])
        return self.strings[found[0] : end], found[1]


class Normalizer:
    """Text to normalised text with the source position of every byte."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool):
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        self.space = MARK.encode() if escape else b" "

    def _step(self, text: bytes, at: int) -> tuple[bytes, int]:
        if self.map and (hit := self.map.longest(text, at)):
            return hit
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + n], n

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset of each of them and of the end."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        return self._plain(text) if self.map is None and not self.remove_extra else self._general(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Nothing but spaces changes: positions follow from their widths."""
        out = (self.space if self.dummy_prefix else b"") + text.replace(b" ", self.space)
        width = np.ones(len(text), dtype=np.int64)
        if len(self.space) > 1:
            width[np.frombuffer(text, dtype=np.uint8) == 32] = len(self.space)
        source = np.repeat(np.arange(len(text), dtype=np.int64), width)
        head = np.zeros(len(self.space) if self.dummy_prefix else 0, dtype=np.int64)
        return out, np.concatenate([head, source, [len(text)]])

    def _general(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at = bytearray(), [], 0
        if self.remove_extra:
            while at < len(text):
                part, n = self._step(text, at)
                if part != b" ":
                    break
                at += n
            if at == len(text):
                return b"", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix:
            out += self.space
            source += [at] * len(self.space)
        after_space = self.remove_extra
        while at < len(text):
            part, n = self._step(text, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                shown = part.replace(b" ", self.space)
                out += shown
                source += [at] * len(shown)
                after_space = part.endswith(b" ")
            at += n
            if not self.remove_extra:
                after_space = False
        if self.remove_extra:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), np.array([*source, at], dtype=np.int64)


class Codec:
    """A loaded model: encodes texts to ids, projects pieces to byte spans, decodes ids."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must mark words with a prefix and fall back to bytes")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("the model must have no pieces that users defined, which bypass its normaliser")
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.width = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        crossing = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.units = re.compile(r"(?s).+" if crossing or not spec.escape_whitespaces else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.begin, self.end = (np.array([i], dtype="<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Ids of units, which are normalised already."""
        for u, ids in zip(units, self.bare.encode(units, num_threads=1), strict=True):
            self.known[u] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, np.ndarray]]:
        """Ids of each text as little-endian 32-bit integers, with begin and end id; length of the normalised text, and its bytes' sources."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        aligned = [self.normalize(t.encode()) for t in texts]
        split = [self.units(normal.decode()) for normal, _ in aligned]
        new = list(set().union(*split) - self.known.keys())
        if new:
            self._learn(new)
        known = self.known
        out = [(b"".join([self.begin, *[known[u] for u in units], self.end]), len(normal), source) for units, (normal, source) in zip(split, aligned, strict=True)]
        for u in new:
            if len(u) > LONGEST:
                del known[u]
        return out

    def spans(self, length: int, source: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """First and past-the-end byte in the text of every id; begin and end id get empty spans. None if pieces don't add up."""
        ends = np.cumsum(self.width[ids[1:-1]])
        if (ends[-1] if len(ends) else 0) != length:
            return None
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.concatenate([[0], source[begins], source[-1:]]), np.concatenate([[0], source[ends], source[-1:]])

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids."""
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def load_model(path: str) -> bytes:
    """The model file, read on the driver; a vocabulary has a fixed size, so it can go to every task."""
    with open(path, "rb") as f:
        return f.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, begins and ends (byte spans in the text) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            found = codec.encode(b.column(1).to_pylist())
            ids = [np.frombuffer(x, dtype="<u4") for x, *_ in found]
            spans = [codec.spans(*where, x) for (_, *where), x in zip(found, ids, strict=True)]
            begins, ends = ([s and s[k].astype(np.int32) for s in spans] for k in range(2))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                ],
                ["doc_id", "ids", "begins", "ends"],
            )

    return arrow_map(_texts(docs), run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select(F.col("doc_id").cast("bigint"), "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """Encodes, projects and decodes every document, and returns counts and hashes instead of the ids.

    doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256, spans_sha256 (all begins,
    then all ends, as little-endian unsigned 32-bit).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            rows = []
            for raw, *where in codec.encode(b.column(1).to_pylist()):
                ids = np.frombuffer(raw, dtype="<u4")
                spans = codec.spans(*where, ids)
                rows.append((len(ids), sha(raw), sha(codec.decode(ids).encode()), spans and sha(b"".join(x.astype("<u4").tobytes() for x in spans))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return arrow_map(_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
