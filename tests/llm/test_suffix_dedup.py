import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, id string, marks string"


def brute(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, sha) by comparing all windows."""
    places = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            place = (sd.NO_ID if doc is None else doc, i)
            w = raw[i : i + length]
            places[w] = min(places.get(w, place), place)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        cover = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if places[raw[i : i + length]] < (sd.NO_ID if doc is None else doc, i):
                cover[i : i + length] = [True] * length
        stay = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((doc, len(raw), sum(cover), spans, hashlib.sha256(stay).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(10, len(p))], word()]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 300), (101, "ab" * 150), (102, None), (103, ""), (None, rows[3][1]), (104, rows[5][1]), (105, rows[5][1]), (5, rows[5][1]), (106, "xy")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,gram,hot", [(16, 6, 2048), (16, 6, 1), (40, 9, 3), (100, 20, 2048)])
def test_equals_brute_force(spark, length, gram, hot):
    rows = corpus(length)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = sd.remove_repeats(df, length, gram, hot, keep_text=False)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, length)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_owners_and_sorters(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    monkeypatch.setattr(sd, "OWNED", 1 << 9)
    monkeypatch.setattr(sd, "SORTED", 1 << 9)
    monkeypatch.setattr(sd, "FINE", 2)
    got = sd.remove_repeats(df, 16, 6, 2, keep_text=False)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 16)


def test_chunks_of_a_long_text_change_nothing(spark, monkeypatch):
    rows = corpus(8, 12)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).coalesce(1)
    monkeypatch.setattr(sd, "CHUNK", 64)
    _, at, n, _, _ = sd.segments([b"abcd" * 200], 16, 6)
    assert (np.diff(at) == n[:-1]).all() and n.sum() == 785
    got = sd.remove_repeats(df, 16, 6, keep_text=False)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 16)


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_is_sorted_to_its_depth(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 400)).astype(np.uint8)
    if seed == 7:
        text = np.full(300, 97, dtype=np.uint8)
    depth = int(rng.integers(8, 40))
    order = sd.suffix_array(text, depth)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert keys == sorted(keys)
    shared = sd.common_prefixes(order, sd.words_of(text, depth), depth)
    for a, b, n in zip(keys, keys[1:], shared[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == same or len(a) < depth or len(b) < depth


def test_wanted_suffixes_are_sorted_among_themselves():
    rng = np.random.default_rng(9)
    for _ in range(30):
        text = rng.integers(97, 100, 200).astype(np.uint8)
        wanted = rng.random(200) < 0.3
        full = [i for i in sd.suffix_array(text, 250) if wanted[i]]
        assert [i for i in sd.suffix_array(text, 250, None, wanted) if wanted[i]] == full


def test_types():
    text = np.frombuffer(b"mississippi", dtype=np.uint8)
    want = [text[i:].tobytes() < text[i + 1 :].tobytes() for i in range(len(text))]
    assert sd.smaller_than_successor(text).tolist() == want


def test_different_texts_of_one_id_have_own_marks(spark):
    rng = random.Random(31)
    piece = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared, other = piece(200), piece(200)
    rows = [(1, shared), (5, "x" + piece(300) + shared), (5, piece(50)), (5, piece(400)), (None, piece(40)), (None, other), (None, "y" + piece(150) + other), (9, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {}
    for r in sd.remove_repeats(df).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r.n_removed)
    assert got[1, 200] == [0] and got[5, 501] == [200] and got[5, 50] == [0] and got[5, 400] == [0]
    assert got[None, 40] == [0] and got[9, 200] == [200] and got[None, 200] + got[None, 351] in ([200, 0], [0, 200])


def test_a_text_of_one_repeated_byte(spark, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 1000)
    rows = [(1, "a" * 200_000), (2, "a" * 150), (3, None), (4, "b" * 99)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (200_000, 199_999, 1), 2: (150, 150, 1), 3: (0, 0, 0), 4: (99, 0, 0)}
