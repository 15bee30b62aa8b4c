import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world", " lead", "trail ", "  two  spaces ", "a▁b ▁▁ c", "tab\tnew\nline\r\n\n", "Grüße, 世界! 🙂🙂 ", "", " ", "   ", "▁", "\u0000x\u0001", "<s> </s> [INST]",
    "x" * 5000, "word " * 3000, "é" * 700 + " ", "ﬁ ½ Å", None,
]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_digest_is_what_the_library_gives(spark, lib):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "null id", "n"), (1, TEXTS[1], "n")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in sc.digest(df, sc.load_model(MODEL)).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert None in got


def test_spans_and_round_trip(spark, lib):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = sc.load_model(MODEL)
    encoded = sc.encode(df, model)
    for r in encoded.collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert r.begins[0] == r.ends[0] == 0 and r.begins[-1] == r.ends[-1] == len(raw)
        covered = b""
        for i, b, e in list(zip(r.ids, r.begins, r.ends))[1:-1]:
            piece = lib.id_to_piece(int(i))
            shown = bytes([int(piece[3:5], 16)]) if lib.is_byte(int(i)) else piece.encode().replace("▁".encode(), b" ")
            assert raw[b:e].replace("▁".encode(), b" ") in (shown, shown[1:])  # the first mark has no source
            covered += raw[b:e]
        assert covered == raw
    back = {r.doc_id: r.text for r in sc.decode(encoded, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))


def test_empty_table(spark):
    assert sc.digest(spark.createDataFrame([], "doc_id long, text string"), sc.load_model(MODEL)).count() == 0


def compiled_map(replacements):
    """A character map for a few strings: a double-array trie, placed greedily, and the replacements behind it."""
    blob, at = b"", {}
    for new in dict.fromkeys(replacements.values()):
        at[new] = len(blob)
        blob += new.encode() + b"\0"
    trie: dict = {}
    for old, new in replacements.items():
        node = trie
        for byte in old.encode():
            node = node.setdefault(byte, {})
        node[None] = at[new]
    units, used = [0] * 4096, {0}

    def place(node, here):
        labels = [0 if x is None else x for x in node]
        base = next(b for b in range(1, 1 << 20) if all((b ^ x) not in used and (b ^ x) < len(units) for x in labels) and (here ^ b) < 1 << 21)
        used.update(base ^ x for x in labels)
        units[here] |= (here ^ base) << 10 | (256 if None in node else 0)
        for x, child in node.items():
            if x is None:
                units[base] = 1 << 31 | child
            else:
                units[base ^ x] |= x
                place(child, base ^ x)

    place(trie, 0)
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + blob


MAP = {"ﬁ": "fi", "½": "1/2", "a": "a", "ab": "X", "abc": "yy", "\u3000": " ", "\u00ad": "", "e\u0301": "é", "\t": " "}


@pytest.mark.parametrize("extra", [True, False])
def test_character_map_takes_the_longest_prefix_and_keeps_sources(extra):
    own = sc.Normalizer(compiled_map(MAP), True, extra, True)
    normal, source = own("ﬁx".encode())
    assert normal.decode() == "▁fix" and source.tolist() == [0, 0, 0, 0, 0, 3, 4]
    normal, source = own("abd ab abc ½".encode())
    assert normal.decode() == "▁Xd▁X▁yy▁1/2" and source[-1] == 13
    assert source[: len("▁Xd".encode())].tolist() == [0, 0, 0, 0, 2]


@pytest.mark.parametrize("extra", [True, False])
def test_a_model_with_a_map_encodes_as_the_library_does(extra):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(sc.load_model(MODEL))
    proto.normalizer_spec.precompiled_charsmap = compiled_map(MAP)
    proto.normalizer_spec.remove_extra_whitespaces = extra
    model = proto.SerializeToString()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sc.Codec(model)
    texts = ["ﬁne ½ abc abd ab", "  a   b\u3000c\t d  ", "①②", "e\u0301 x", "plain text", " ", "\u00ad a", "", "a\u3000\u3000 ", "▁x ▁", "ab" * 500]
    for text, (raw, length, source) in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(raw, dtype="<u4")
        assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True), text
        begins, ends = codec.spans(length, source, ids)
        assert (begins <= ends).all() and (np.diff(begins) >= 0).all() and ends.max() <= len(text.encode())
        normal, _ = codec.normalize(text.encode())
        assert normal.decode() == lib.normalize(text)


def test_pieces_that_do_not_add_up_give_no_spans():
    codec = sc.Codec(sc.load_model(MODEL))
    assert codec.spans(99, np.zeros(1, dtype=np.int64), np.array([1, 2])) is None


def test_forgetting_units_changes_nothing(lib, monkeypatch):
    monkeypatch.setattr(sc, "REMEMBERED", 3)
    codec = sc.Codec(sc.load_model(MODEL))
    for t in ["one two three four five", "six seven one two", "two " * 50 + "y" * 100]:
        assert np.frombuffer(codec.encode([t])[0][0], dtype="<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)
